"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries; every other module holds one operator.
"""
