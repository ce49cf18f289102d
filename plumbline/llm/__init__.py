"""Training-data operators: extraction, deduplication, scoring, filtering, packing.

Nothing outside this folder imports it.
"""
