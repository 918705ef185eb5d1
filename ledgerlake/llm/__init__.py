"""Training-data operators: quality, toxicity, language, duplicates, shards, chat and tokens.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only where it is present.
"""
