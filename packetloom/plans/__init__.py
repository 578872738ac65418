"""Composed plans and the registered queries."""
