"""Operators for training-data corpora: one module each, their queries and their SQL."""
