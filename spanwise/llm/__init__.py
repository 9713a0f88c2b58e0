"""Operators for large text corpora: near duplicates, language, tokens, personal data, mixing, vectors."""
