"""All queries over the record model, with the SQL that checks them."""

from __future__ import annotations

from wardline.plans import clinical, details, files, records, resolution, service, stores, texts

_MODULES = (records, resolution, texts, clinical, service, files, stores, details)


def queries():
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
