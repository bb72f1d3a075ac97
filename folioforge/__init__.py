"""Distributed document engine on PySpark: read, query, edit and convert corpora of documents as DataFrames."""
