"""Column functions: text, tokens, query variants, tags."""
