"""Runnable queries over the given tables, one module per operator family."""

from importlib import import_module

FAMILIES = (
    "geometry_queries",
    "temporal_queries",
    "quality_queries",
    "evaluation_queries",
    "alignment_queries",
    "estimation_queries",
    "rules_queries",
    "contract_queries",
    "movement_queries",
    "source_queries",
    "streaming_queries",
)


def load_all():
    from .registry import ORACLES, QUERIES

    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return QUERIES, ORACLES
