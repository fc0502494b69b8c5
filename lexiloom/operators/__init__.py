"""Relational operators over files, lines, tokens, codes and pixels."""
