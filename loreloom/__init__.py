"""Spark-native document memory, retrieval and evaluation analytics."""

__version__ = "0.1.0"
