"""Spark-native provenance analytics: claims, evidence, coverage, curation and retrieval as DataFrame plans."""
