"""Column functions: patterns, spans, checks, tokens, replacement values."""
