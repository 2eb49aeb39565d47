"""Lodemark: market-research analytics as Spark DataFrame jobs."""
