"""The registered queries of the core and their SQL twins."""

from __future__ import annotations


def _modules() -> list:
    from arcweave.queries import algorithms, cypher, feeds, fin, updates

    return [cypher, fin, updates, algorithms, feeds]


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
