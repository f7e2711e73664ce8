"""Importing this module registers every query."""

from lodeline.catalog import context, corpus, learning, profiles, recommend, streams, telemetry, timeline  # noqa: F401
from lodeline.catalog import invariants  # noqa: F401, E402  (runs queries of the others)
