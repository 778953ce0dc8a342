"""Readers of logs, feeds and pages, and keyed stores on Parquet."""
