"""Spark-native event and knowledge analytics engine."""
