"""Whole jobs: packing, unpacking, the registered queries."""
