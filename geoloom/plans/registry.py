"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from geoloom.plans import context, core, more, places, wire

MODULES = (core, more, wire, places, context)  # each adds its queries to the tables in core

FLAGSHIP = "q_transit_slice"
QUERIES = dict(core.QUERIES)
SQL = dict(core.SQL)
