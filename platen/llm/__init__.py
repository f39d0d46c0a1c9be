"""Training-data operators: filtering, deduplication, mixing, packing.

Nothing outside this subpackage imports it.
"""
