"""Relational operators over a corpus of texts."""
