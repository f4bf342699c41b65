"""Spark-native analytics for labelled biological sequences."""

__version__ = "0.1.0"
