"""Exact retrieval and sequence analytics as ordinary Spark DataFrame transformations."""
