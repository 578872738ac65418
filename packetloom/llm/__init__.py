"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; queries.py lists what it registers.
"""
