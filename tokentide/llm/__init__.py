"""Training-data operators: ten distributed jobs over ``documents``-like tables.

Nothing outside this subpackage imports it.
"""
