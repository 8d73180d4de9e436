"""Training-data operators: extraction, deduplication, mixing and packing of text corpora.

Nothing else in the package imports this subpackage.
"""
