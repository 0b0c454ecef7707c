"""All registered queries of the engine and their oracles."""

from __future__ import annotations

from functools import wraps

from ..functions.shipping import ship
from . import analysis_queries, further_queries, indicator_queries, more_oracles, relational_queries, signal_queries, streaming_queries


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


_MODULES = (indicator_queries, signal_queries, relational_queries, analysis_queries, streaming_queries, further_queries)
QUERIES = {k: _shipped(v) for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()} | more_oracles.ORACLES
ORACLES |= {"spc_vote": more_oracles.spc_vote(ORACLES), "feature_mutual_information": more_oracles.mutual_information(ORACLES)}
