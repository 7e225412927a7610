"""Registered queries over the given tables."""

from tessera.catalog import files, graph, products, retrieval, streams, views  # noqa: F401
from tessera.catalog.registry import ORACLES, QUERIES, expand  # noqa: F401
