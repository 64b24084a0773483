"""Operators that prepare text and vector collections for training.

Each module holds one operator; :mod:`loamdex.llm.queries` names the queries.
Nothing outside this package imports it.
"""
