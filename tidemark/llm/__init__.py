"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries.queries()`` and
``queries.oracle_sql()`` list what the driver entry registers.
"""
