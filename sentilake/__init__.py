"""Spark-native public-opinion analytics: links, documents, cleaning, scoring, reporting."""
