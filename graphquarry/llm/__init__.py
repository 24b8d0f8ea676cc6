"""Operators for training data made of text, source code and vectors. Nothing outside this package imports it."""
