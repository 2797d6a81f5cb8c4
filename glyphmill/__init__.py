"""Lexical features and embeddings of text corpora, written as Spark plans."""
