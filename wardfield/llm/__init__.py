"""Operators for preparing language-model training data, each in a module of its own.

Nothing else in the package imports this folder. ``registry`` holds the queries.
"""
