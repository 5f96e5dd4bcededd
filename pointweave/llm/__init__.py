"""Training-data operators: near-duplicate removal, filters, mixing, tokens, shards.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
