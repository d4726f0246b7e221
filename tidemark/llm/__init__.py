"""Operators for large text corpora used in model training.

Nothing outside this package imports it.  Each module holds one operator with
a general interface; ``registry`` derives the fixed-column queries from them.
"""
