"""Column expressions: text cleaning, tokens, vectors."""
