"""Spark-native operators for analysing contests between pairs of entities."""

__version__ = "0.1.0"
