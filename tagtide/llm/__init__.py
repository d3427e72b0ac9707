"""Operators of a training-data pipeline over whole corpora.

Each module holds one operator with its own general interface; the thin
registered queries are in ``queries.py``.  Nothing else in the library imports
this package.
"""
