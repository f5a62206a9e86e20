"""Training-data operators: near-duplicates, scans, filters, models, archives and mixing.

Each module holds one operator with its own interface; `catalog` registers the
queries that apply them to the given tables.
"""
