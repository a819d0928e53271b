"""Metrics analytics on Spark: scraped samples in, range queries and reports out."""
