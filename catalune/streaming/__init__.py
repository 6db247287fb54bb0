"""Structured Streaming forms of the ordered folds, and event-time windows."""
