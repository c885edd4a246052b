"""Corpus retrieval, graph expansion and evaluation as Spark DataFrame operators."""
