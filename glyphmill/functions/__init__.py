"""Column functions and Arrow functions on texts, tokens and vectors."""
