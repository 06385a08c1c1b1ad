"""All core queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from glyphmill.plans import coherent, discourse, filling, learning, stylometry, tables, temporal

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (tables, filling, stylometry, discourse, coherent, temporal, learning):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
