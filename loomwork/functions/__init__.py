"""Column functions: tokens, scores, paths, literals."""
