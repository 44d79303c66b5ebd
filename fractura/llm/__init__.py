"""Training-data operators: joins, search, classifiers, tokenising, packing, deduplication and URL filters.

Nothing outside this subpackage imports it.
"""
