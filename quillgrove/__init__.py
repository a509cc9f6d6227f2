"""Spark-native document structure analytics."""
