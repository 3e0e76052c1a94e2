"""Registered queries over the driver's tables, with their SQL."""

from tidemark.plans import aggregates, files, learning, more, probability, quality, relational, streams, temporal  # noqa: F401
from tidemark.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
