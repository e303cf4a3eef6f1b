"""Operators for preparing training and evaluation text at scale.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
