"""Spark-native analytics over health records, built on DataFrame, SQL and Structured Streaming."""
