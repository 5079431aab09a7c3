"""Spark-native retrieval and usage-memory analytics engine."""
