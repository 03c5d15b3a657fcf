"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage, and it imports nothing
but the public libraries named in the README.
"""
