"""Spark-native document analytics: sources."""
