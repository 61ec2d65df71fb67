"""Training-data operators: language, quality, deduplication, decontamination, extraction, packing.

Nothing else in the library imports this subpackage.
"""
