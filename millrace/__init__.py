"""Spark-native evaluation of structured extraction from long documents, and corpus preparation."""
