"""Operators on DataFrames: n-gram counts, vocabularies, features, projection, training, evaluation."""
