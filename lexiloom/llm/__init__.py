"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; the rest of the library works with the folder deleted.
"""
