"""Millrace: postings and operations analytics, and corpus preparation, as PySpark transforms."""
