"""Spark-native engine for document fields, block features, scoring and corpus statistics."""
