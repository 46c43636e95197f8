"""DuckDB statements that recompute each query from the source tables."""

from oracles import catalog, classify, dups, feed, identity, neighbors, search, shelves, streams

ORACLES: dict[str, str] = {}
for _module in (catalog, classify, dups, feed, identity, neighbors, search, shelves, streams):
    ORACLES.update(_module.SQL)
