"""Corpus retrieval, curation and evaluation analytics as Spark DataFrame operators."""
