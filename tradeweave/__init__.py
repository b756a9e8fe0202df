"""Marketplace analytics as PySpark DataFrames."""
