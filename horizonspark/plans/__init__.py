"""Registered queries: the operators applied to the star-schema tables, each with the same result as SQL."""
