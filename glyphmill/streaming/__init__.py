"""Structured Streaming forms of the operators that corpora growing by files need."""
