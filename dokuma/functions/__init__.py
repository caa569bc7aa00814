"""Column functions: normalisers, keys, scores."""
