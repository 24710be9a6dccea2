"""Training-data operators: mixing, quality rules, decontamination, token files, dedup, scoring.

Every module holds one operator with its own general interface; ``registry`` holds the
thin ``opN_*`` queries.  Nothing outside this package imports it.
"""
