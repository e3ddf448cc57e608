"""Convergent-data analytics as Spark jobs."""
