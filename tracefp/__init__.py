"""Spark-native analytics for web-traffic session logs."""
