"""Training-data operators: tokenisation, deduplication, filtering, packing, formatting.

Nothing else in tidemark imports this subpackage.
"""
