"""Registered queries over the derived views; importing a module registers its queries."""

from . import decisions, discovery, files, gates, generation, ideas, joins, market, performance, records, recurrent, research, robustness, strategies, streams, walkforward
from .registry import COVERS, QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


__all__ = ["COVERS", "decisions", "discovery", "files", "gates", "generation", "ideas", "joins", "market", "oracle_sql", "performance", "queries", "records", "recurrent", "research", "robustness", "strategies", "streams", "walkforward"]
