"""Spark-native analytics for network-flow tables."""
