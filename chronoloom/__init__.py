"""Spark-native analytics for temporal networks."""
