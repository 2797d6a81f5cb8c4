"""Readers and writers: Parquet corpora, label lines, models, sparse and dense matrices."""
