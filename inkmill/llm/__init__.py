"""Training-data operators: tokens, duplicates, mixing, search and document scores.

Nothing else in the library imports this subpackage.
"""
