"""Operators for building training corpora: tokens, extraction, duplicates, mixing, search, privacy, leaks, quality, language."""
