"""Spark-native quantitative time-series analytics."""
