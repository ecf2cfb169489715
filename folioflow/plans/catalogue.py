"""All registered queries of the document flow."""

from __future__ import annotations

from folioflow.plans import books, judged, judgement, layouts, texts

MODULES = [texts, layouts, judgement, judged, books]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
