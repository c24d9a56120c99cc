"""Readers: parquet tables, delimited files, JSON and XML documents, and the dataset catalog."""
