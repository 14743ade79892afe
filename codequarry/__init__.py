"""Spark-native relational engine over source repositories and text corpora."""

__version__ = "0.1.0"
