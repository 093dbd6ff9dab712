"""Training-data operators: deduplication, classifiers, tokens, mixing, archives.

Nothing outside this package imports it. ``catalog`` holds one query per operator.
"""
