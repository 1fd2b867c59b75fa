"""Training-data operators: deduplication, filtering, packing, sharding, search, extraction.

Each module holds one operator with its own general interface; ``queries`` holds the thin
queries that apply them to the standard tables. Nothing outside this subpackage imports it.
"""
