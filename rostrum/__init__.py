"""Rostrum: a PySpark-native engine for large collections of public comments and their official answers."""
