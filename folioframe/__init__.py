"""Spark-native document ontology and retrieval engine."""
