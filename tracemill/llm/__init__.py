"""Training-data operators: token counts, packing, deduplication, search and classifiers.

Nothing else in the library imports this subpackage.  ``registry`` holds the
registered queries and their SQL.
"""
