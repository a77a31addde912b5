"""Granary: Spark-native analytics over financial statements."""
