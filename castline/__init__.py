"""Catch-report analytics as Spark DataFrame jobs."""
