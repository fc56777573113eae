"""Spark-native agent memory: filtering, retrieval, learning and skill mining as DataFrame operators."""
