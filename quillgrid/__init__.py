"""Spark-native entity resolution and data-quality analytics."""
