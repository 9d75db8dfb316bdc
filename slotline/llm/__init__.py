"""Operators for corpora of text and for sampling and splitting training data. Nothing outside this package imports it."""
