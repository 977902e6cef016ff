"""Spark-native document retrieval, dialogue and corpus analytics."""
