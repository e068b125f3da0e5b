"""Training-data operators: extraction, tokenisation, deduplication, filtering and scanning of text.

Nothing else in the library imports this subpackage.
"""
