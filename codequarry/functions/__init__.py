"""Column functions: texts, paths, scores, redaction."""
