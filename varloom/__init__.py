"""Variant-table harmonisation as Spark jobs."""
