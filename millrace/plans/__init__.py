"""Registered queries over the star-schema tables, each with its SQL."""

from millrace.plans import delivery_queries, event_queries, file_queries, order_queries, report_queries, running_queries, text_queries

_ALL = (event_queries, order_queries, text_queries, delivery_queries, report_queries, running_queries, file_queries)
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _ALL for name, sql in module.ORACLES.items()}
