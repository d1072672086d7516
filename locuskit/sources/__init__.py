"""Readers of delimited input files, and Parquet tables."""
