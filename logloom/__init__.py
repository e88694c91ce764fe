"""Spark-native analytics over append-only session logs and conversation tables."""
