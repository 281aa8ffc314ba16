"""Training-data operators: mixing, filtering, deduplication, tokenisation and scoring over document tables.

Nothing outside this subpackage imports it.
"""
