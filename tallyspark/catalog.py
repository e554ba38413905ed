"""All queries by name, with the SQL that gives the same rows."""

from tallyspark.plans import analytics, collection, events, more, streams

FLAGSHIP = "A06_totals_by_source"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (analytics, events, more, streams, collection):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
