"""Spark-native analytics for Internet routing data."""
