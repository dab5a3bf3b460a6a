"""Operators: DataFrames in, a DataFrame out, no action inside (the cone alone cuts its lineage)."""
