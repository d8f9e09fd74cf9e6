"""Spark-native toolkit for everyday business-data work."""
