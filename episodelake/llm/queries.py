"""Named queries of the subpackage, and the SQL that each is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from episodelake.llm import encode, mix, percentiles, personal, splits

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, tuple[Query, str | None]] = {
    "p4_percentiles": (percentiles.by_robot, None),
    "p4_months": (percentiles.by_month, None),
    "p5_found": (splits.found, splits.FOUND_SQL),
    "p5_split": (splits.frame_split, None),
    "p6_ids": (encode.token_ids, None),
    "p7_mixture": (mix.mixture, None),
    "p7_report": (mix.report, None),
    "p8_found": (personal.found, None),
    "p8_redacted": (personal.redacted, None),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: s for name, (_, s) in QUERIES.items() if s}
