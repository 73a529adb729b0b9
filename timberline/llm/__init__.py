"""Operators for preparing language-model training data.

Each module holds one operator with a general DataFrame interface;
``queries`` registers the thin ``opN_*`` queries on top of them. Nothing
outside this subpackage imports it.
"""
