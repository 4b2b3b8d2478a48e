"""Registered queries: every operator over the driver's tables, with its SQL twin."""

from siftgate.queries import bytes_, events, layers, runs, streams, tables, texts  # noqa: F401
from siftgate.queries.base import ORACLES, QUERIES  # noqa: F401
