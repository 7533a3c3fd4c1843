"""Operators for corpora of training text. Nothing else in the package imports this folder."""
