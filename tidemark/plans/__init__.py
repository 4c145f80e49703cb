"""Composite plans over the operators."""
