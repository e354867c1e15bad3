"""Training-data operators (near-dedup, tokenisation, archives, filters, mixing).

Nothing outside this subpackage imports it.
"""
