"""Operators for building language-model training data, one module each.

Nothing outside this subpackage imports it, except that ``__spark_entry__`` adds its queries if it is there.
"""
