"""Sources: adapters from raw inputs to the canonical catalogue."""
