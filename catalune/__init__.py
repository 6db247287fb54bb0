"""A PySpark-native analytics engine for large multi-source catalogues."""
