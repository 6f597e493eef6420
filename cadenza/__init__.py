"""Royalty analytics on Spark: ingestion, catalog, splits, queries and event flow."""
