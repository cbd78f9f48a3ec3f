"""Readers and writers of the flows: CSV, Parquet and JSON."""
