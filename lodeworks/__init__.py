"""Spark-native evidence analytics: retrieval, fusion, grounding, trust, provenance and evaluation as DataFrame plans."""
