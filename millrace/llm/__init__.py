"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL; every other module holds one operator.
"""
