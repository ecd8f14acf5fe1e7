"""Catalog understanding, batch table retrieval and retrieval scoring on Spark."""
