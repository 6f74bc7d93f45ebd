"""Training-data operators: tokenising, deduplication, language-model scoring,
token files, mixing, quality, token counts and toxicity.

Nothing else in the library imports this package.  Every operator takes plain
DataFrames or columns; ``queries`` holds the registered queries, and
``oracle_sql`` the SQL of those that SQL can express.
"""
