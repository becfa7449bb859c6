"""Training-data operators: mixing, dedup, quality, tokens, language, WARC.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when it is present.
"""
