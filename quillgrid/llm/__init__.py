"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` holds the thin registered
queries that turn operator outputs into digest rows.
"""
