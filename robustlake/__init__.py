"""Robustness-evaluation analytics and training-data operators on PySpark."""
