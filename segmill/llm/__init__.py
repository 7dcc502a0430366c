"""Training-data operators: mixing, sharding, scans, deduplication, packing.

Nothing outside this subpackage imports it.
"""
