"""Operators that prepare texts for training language models."""
