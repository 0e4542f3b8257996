"""Column expressions: patterns, normalisation, tokens, replacement values, geometry."""
