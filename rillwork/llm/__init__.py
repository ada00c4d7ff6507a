"""Operators for large training corpora; see README.md."""
