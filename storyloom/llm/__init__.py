"""Operators for building training corpora from document tables.

One module per operator; ``queries`` and ``oracle`` register them.  Nothing
outside this package imports it.
"""
