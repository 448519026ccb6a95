"""All registered queries and their SQL."""

from __future__ import annotations

from cartloom.plans import (
    event_oracle,
    event_queries,
    match_oracle,
    match_queries,
    session_oracle,
    session_queries,
    table_oracle,
    table_queries,
    url_oracle,
    url_queries,
)
from cartloom.plans.url_queries import Query


QUERIES: dict[str, Query] = {
    name: query
    for part in (url_queries, event_queries, match_queries, session_queries, table_queries)
    for name, query in part.QUERIES.items()
}
ORACLE: dict[str, str] = {
    name: text
    for part in (url_oracle, event_oracle, match_oracle, session_oracle, table_oracle)
    for name, text in part.ORACLE.items()
}
