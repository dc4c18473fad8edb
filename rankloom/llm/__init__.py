"""Operators that prepare text for training data.

Nothing outside this folder imports it; ``registry`` holds its named queries.
"""
