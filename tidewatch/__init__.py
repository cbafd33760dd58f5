"""Spark-native analytics over threat reporting: see README.md."""
