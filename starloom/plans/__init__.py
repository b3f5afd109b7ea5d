"""Metadata: the described tables and facts, and what is derived from them."""
