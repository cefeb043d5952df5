"""Operators for training-data pipelines over ``documents`` and ``embeddings``.

Nothing outside this subpackage imports it; ``queries`` registers one query per operator.
"""
