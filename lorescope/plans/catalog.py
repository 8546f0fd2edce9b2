"""All named queries."""

from lorescope.plans import (  # noqa: F401  (importing registers)
    agreement_queries,
    graph_queries,
    metric_queries,
    mining_queries,
    record_queries,
    reshape_queries,
    stream_queries,
    text_queries,
    vector_queries,
    vote_queries,
)
from lorescope.plans.registry import QUERIES, TWINS  # noqa: F401
