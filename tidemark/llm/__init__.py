"""Operators for large text corpora used in training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface plus a thin ``query`` function that is registered by
:mod:`tidemark.llm.registry`.
"""
