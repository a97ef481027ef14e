"""Operators for preparing large text corpora as training data.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; every other module holds one operator with its own interface.
"""
