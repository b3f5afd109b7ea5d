"""Operators for text corpora and very large identifier sets. Nothing outside imports this package."""
