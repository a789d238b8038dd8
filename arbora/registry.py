"""The registered queries of the network engine and their DuckDB oracles."""

from __future__ import annotations

from arbora.plans import capsules, chains, crop, edits, files, forest, histories, joins, masks, morphometry, reconnect, resistors, rooting, scalars, spans, upward, voxels, walls

FLAGSHIP = "order_statistics"
MODULES = [morphometry, spans, joins, forest, edits, voxels, scalars, rooting, upward, chains, masks, resistors, capsules, histories, files, crop, walls, reconnect]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
