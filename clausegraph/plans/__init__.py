"""Queries of the library; importing this package registers them."""

from . import answers, evaluation, graph, ingest, nodes, numerics, streams, topology  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
