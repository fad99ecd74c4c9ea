"""Training-data operators: quality, language, near duplicates, repeats,
personal data, mixing, tokenising and vector search.

Nothing else in the package imports this subpackage.  ``catalog`` holds its
registered queries and their SQL.
"""
