"""Imports every query module so that the registry is complete."""

from medialib.plans import (  # noqa: F401
    catalog_queries,
    classify_queries,
    dup_queries,
    feed_queries,
    identity_queries,
    neighbor_queries,
    search_queries,
    shelf_queries,
    stream_queries,
)
from medialib.plans.registry import QUERIES

__all__ = ["QUERIES"]
