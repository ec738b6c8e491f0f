"""Operators for preparing training data at cluster scale.

Nothing else in the library imports this subpackage; it can be removed and the
rest still works.
"""
