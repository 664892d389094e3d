"""Registered queries over the given tables."""

from streamjobs.catalog import (experiments, generated, latencies, learning, logs, network, ports,  # noqa: F401
                                rides, streams, text, vessels)
from streamjobs.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
