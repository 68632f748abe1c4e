"""Incremental, content-addressed ingest and dedup on DataFrames."""
