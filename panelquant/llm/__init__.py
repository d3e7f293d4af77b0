"""Operators for preparing language-model training data at corpus scale.

Each module holds one operator; ``entry.py`` registers the queries. Nothing
outside this subpackage imports it.
"""
