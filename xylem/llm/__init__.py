"""Operators for large training-data corpora.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
in :mod:`xylem.llm.entry` hold the registered queries.
"""
