"""Importing this module registers every query."""

from pairlab.queries import (  # noqa: F401
    aggregates, analyses, charts, joins, models, projections, sources, statistics, windows,
)
