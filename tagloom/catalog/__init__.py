from tagloom.catalog import (  # noqa: F401
    curve_queries,
    govern_queries,
    graph_queries,
    join_queries,
    ledger_queries,
    neighbour_queries,
    observe_queries,
    rank_queries,
    retrieve_queries,
    stream_queries,
    text_queries,
    write_queries,
)
from tagloom.catalog.base import QUERIES, sql_texts  # noqa: F401
