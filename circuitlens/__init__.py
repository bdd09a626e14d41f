"""Spark-native analytics over searches of small regulatory networks."""
