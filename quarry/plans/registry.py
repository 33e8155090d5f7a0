"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from quarry.plans import catalogue, oracles, round_trips

QUERIES = catalogue.QUERIES | round_trips.QUERIES
ORACLES = oracles.ORACLES | round_trips.oracles(oracles._HITS)
