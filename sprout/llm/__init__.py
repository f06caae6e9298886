"""Training-data operators: tokenising, scanning, filtering, deduplicating, packing.

Nothing else in the library imports this package; ``queries`` holds the
registered queries and ``corpus_pipeline.py`` (repository top) chains five of
the operators.
"""
