"""Operators for preparing training text: dedup, counting, search, sharding, scoring, packing.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and their SQL; every other module is one operator.
"""
