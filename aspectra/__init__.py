"""Aspect-rating analytics over review text, as Spark DataFrame jobs."""
