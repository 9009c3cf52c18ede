"""Training-data operators: dedup, tokens, mixing, filters, search, WARC.

Nothing outside this subpackage imports it.
"""
