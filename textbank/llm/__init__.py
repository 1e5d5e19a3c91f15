"""Operators for building training data from a corpus of documents.

Nothing else in the library imports this subpackage.
"""
