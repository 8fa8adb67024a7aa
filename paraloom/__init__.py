"""Spark-native analytics for two near-identical, competing sources observed at ordered sites."""
