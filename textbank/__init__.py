"""Corpus, retrieval and assessment analytics as Spark DataFrame operators."""
