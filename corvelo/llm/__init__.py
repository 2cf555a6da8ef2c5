"""Operators for preparing training data and evaluation material at scale.

Nothing outside this subpackage imports it. `corvelo.llm.queries` holds the pN_ queries and their SQL.
"""
