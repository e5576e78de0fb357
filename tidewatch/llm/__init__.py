"""Training-data operators: fingerprints, filters, near-duplicate joins, tokenisation, mixing.

Nothing outside this subpackage imports it.
"""
