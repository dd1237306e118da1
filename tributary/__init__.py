"""Spark-native entity resolution: staging, features, blocking, scoring, clustering and golden records."""
