"""All named queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from episodelake.operators import detectors, grid, health, implausible, logs, partitions, references, sampling, schemas, warehouse

Query = Callable[[SparkSession, str], DataFrame]

PROBLEMS: dict[str, tuple[Query, str | None]] = {
    "p1_found": (implausible.found, None),
    "p1_cases": (implausible.cases, None),
    "p2_found": (grid.empty_slots, grid.FOUND_SQL),
    "p2_grid": (grid.frame_grid, grid.GRID_SQL),
    "p3_found": (references.found, references.FOUND_SQL),
    "p3_counts": (references.counts, references.COUNTS_SQL),
}


def registered() -> dict[str, tuple[Query, str | None]]:
    out = dict(PROBLEMS)
    for module in (warehouse, detectors, health, partitions, logs, sampling, schemas):
        out |= module.QUERIES
    return out


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in registered().items()}


def sql() -> dict[str, str]:
    return {name: s for name, (_, s) in registered().items() if s}
