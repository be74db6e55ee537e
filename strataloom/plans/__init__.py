"""Whole plans: the registered queries, the batch run, the serving queries."""


def all_queries():
    from . import graph_queries, history_queries, more_queries, source_queries, text_queries  # noqa: F401
    from .catalog import QUERIES

    return dict(QUERIES)


def all_sql():
    all_queries()
    from .catalog import SQL

    return dict(SQL)
