"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage.  ``queries.py`` holds
the query of each operator and ``oracles.py`` the SQL that checks it.
"""
