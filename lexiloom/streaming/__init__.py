"""Tokens of files that keep arriving."""
