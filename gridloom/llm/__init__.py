"""Operators for preparing language-model training text at scale.

Nothing outside this subpackage imports it.
"""
