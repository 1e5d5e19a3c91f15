"""Structured Streaming forms of the stateful operators, with batch twins."""
