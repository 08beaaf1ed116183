"""Readers and writers: Parquet, nested JSON, HTML rows, request grids, sinks."""
