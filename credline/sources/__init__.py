"""Scans and sinks: stage tables (CSV/Parquet), annotation JSON, frame files."""
