"""Training-data operators: dedup, filters, language ID, packing and token output.

Nothing outside this subpackage imports it.
"""
