"""Micro-batch wrappers around the batch operators."""
