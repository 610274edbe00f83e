"""Operators that prepare a text corpus for language-model training.

Nothing outside this package imports it.  Each module holds one operator with
a general interface; ``queries`` holds the thin queries over the given tables.
"""
