"""Parquet export, ingest and inspection for PySpark."""
