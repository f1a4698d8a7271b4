"""Functions on texts, tokens, numbers and dates."""
