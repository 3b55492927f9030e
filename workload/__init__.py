"""Queries over the given tables, each with the SQL that must give the same rows."""

from workload import (
    batch_queries,
    cluster_queries,
    source_queries,
    text_queries,
    vocab_queries,
    weight_queries,
)

ALL = [
    module.R
    for module in (
        text_queries,
        vocab_queries,
        weight_queries,
        batch_queries,
        cluster_queries,
        source_queries,
    )
]
