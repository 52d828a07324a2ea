"""Spark-native search, grounded-evidence and corpus-preparation operators."""
