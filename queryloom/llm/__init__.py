"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage. ``queries`` holds what the
driver entry registers.
"""
