"""Operators that prepare text for training language models.

Nothing else in the package imports this one.
"""
