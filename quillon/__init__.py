"""Spark-native catalog, integrity and training-data analytics."""
