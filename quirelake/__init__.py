"""Spark-native analytics over collections of PDF files."""
