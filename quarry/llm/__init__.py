"""Training-data operators: cleaning, deduplication, classification, media, sharding, packing.

Nothing else in the library imports this subpackage.
"""
