"""Operators that prepare text and vector collections for training."""
