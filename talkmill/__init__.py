"""Spark-native analytics over archives of AI conversations."""
