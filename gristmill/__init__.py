"""Grounded extraction and corpus processing as PySpark DataFrame operators."""
