"""Training-data operators: deduplication, filtering, packing, search and extraction.

Nothing else in the library imports this subpackage.  Each operator module has
its own general interface; ``queries.py`` holds the thin registered queries.
"""
