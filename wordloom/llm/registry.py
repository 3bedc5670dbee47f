"""All queries of the subpackage."""

from . import native_queries, python_queries

QUERIES = {**native_queries.QUERIES, **python_queries.QUERIES}
ORACLE_SQL = {**native_queries.ORACLE_SQL, **python_queries.ORACLE_SQL}
