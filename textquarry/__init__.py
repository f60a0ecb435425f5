"""Spark-native document analytics: .."""
