"""Training-data operators: quality, privacy, toxicity, deduplication, tokens, search.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
