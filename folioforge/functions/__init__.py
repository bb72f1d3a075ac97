"""Scalar rules of the document engine as Spark column expressions."""
