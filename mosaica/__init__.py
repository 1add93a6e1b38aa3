"""Retrieval and analytics on Spark: tables, text, points, media descriptors, training data."""
