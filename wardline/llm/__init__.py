"""Operators for preparing language-model training data.

Nothing outside this package imports it. ``registry.queries()`` and
``registry.oracle_sql()`` list its queries for the driver.
"""
