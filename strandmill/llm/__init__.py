"""Operators for language-model data: groups of matches, top-N, token ids, leaks and abuse in page texts."""
