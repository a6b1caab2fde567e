"""Versioned Parquet storage and the change log."""
