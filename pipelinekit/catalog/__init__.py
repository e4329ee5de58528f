"""The queries over the sample tables and, per query, the SQL with the same result."""

from pipelinekit.catalog import customers, documents, joins, lookups, rollups, sources, state, texts

MODULES = [customers, sources, joins, state, lookups, rollups, texts, documents]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
