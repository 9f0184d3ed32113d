"""Panels from tables, and their Parquet and CSV forms."""
