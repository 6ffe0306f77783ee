"""Spark-native table loads, run records and scoring analytics."""

__version__ = "0.1.0"
