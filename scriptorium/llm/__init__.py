"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it; ``queries.QUERIES`` and ``queries.ORACLES``
hold its queries.
"""
