"""Drift of document portfolios over time, on PySpark."""
