"""Spark-native analytics over web content, telemetry and text corpora."""
