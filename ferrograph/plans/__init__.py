"""The operators bound to the supplied tables."""

from . import centers, clusters, cycles, graphindex, graphs, links, lookups, machines, mentions, notations, ordered, pivots, procedures, prose, rollups, similarity, steps, streams, textual, tokens, variants, written  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
