"""All queries of the library and their SQL."""

from tickspark.plans import feed_queries, tick_queries

QUERIES = {**tick_queries.QUERIES, **feed_queries.QUERIES}
ORACLE = {**tick_queries.ORACLE, **feed_queries.ORACLE}
