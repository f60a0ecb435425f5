"""Spark-native document analytics: sinks."""
