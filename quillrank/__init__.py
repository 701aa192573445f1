"""Spark-native news ranking, retrieval and evaluation engine."""
