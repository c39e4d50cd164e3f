"""Spark-native analytics for scanned-detector cubes."""
