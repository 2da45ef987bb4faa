"""The catalogue of registered queries and the SQL that each must agree with."""

from __future__ import annotations

from . import globe, learning, matrices, measurements, streams, tables

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (tables, learning, matrices, measurements, globe, streams):
    QUERIES.update(_module.REGISTRY.queries)
    ORACLES.update(_module.REGISTRY.sql)
