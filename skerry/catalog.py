"""All registered queries and their SQL."""

from skerry.plans import array_queries, graph_queries, series_queries, training_queries

_ALL = (series_queries, graph_queries, array_queries, training_queries)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _ALL for k, v in m.ORACLE.items()}
