"""Spatial tile analytics and corpus processing on PySpark."""
