"""Spark-native analytics over AI-assistant session logs."""
