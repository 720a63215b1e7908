"""Training-data operators: mixing, sharding, fingerprints, toxicity, packing,
near and exact deduplication, chat formatting, URL filters and LM scoring.

Nothing else in the library imports this subpackage.
"""
