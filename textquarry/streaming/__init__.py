"""Spark-native document analytics: streaming."""
