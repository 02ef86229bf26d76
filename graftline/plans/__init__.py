"""Composite table operators and the registered queries."""
