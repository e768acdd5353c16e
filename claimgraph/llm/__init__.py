"""Training-data operators: dedup, scoring, mixing, sharding, joins, media, language and tokens.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries.
"""
