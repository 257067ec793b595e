"""A recorded dataset's folder: data/*/*.parquet, meta/episodes/*/*.parquet and meta/info.json. All lazy; only info.json is read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodelake.sources.tables import quoted


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    root: str

    @property
    def base(self) -> str:
        """The root; a leading ~ is the home folder, which Spark doesn't know."""
        return str(Path(self.root).expanduser()) if self.root.startswith("~") else self.root.rstrip("/")

    def frames(self, *columns: str) -> DataFrame:
        """One row per timestep; the named columns only, whatever dots they have."""
        df = self.spark.read.parquet(f"{self.base}/data/*/*.parquet")
        return df.select(*map(quoted, columns)) if columns else df

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/meta/episodes/*/*.parquet")

    def info(self) -> dict:
        text = self.spark.read.option("wholetext", True).text(f"{self.base}/meta/info.json").first()[0]
        return json.loads(text)

    def count(self) -> int:
        """Rows from the files' footers: no column is read."""
        return self.frames().count()

    def rows(self, begin: int, end: int, *columns: str) -> DataFrame:
        """Frames with begin <= index < end."""
        return self.frames(*columns, *(["index"] if columns and "index" not in columns else [])).where((F.col("index") >= begin) & (F.col("index") < end))

    def trajectory(self, episode: int) -> DataFrame:
        """State and action of an episode, by the value of its index, in frame order. Raises ValueError if there's no such episode."""
        df = self.frames("episode_index", "frame_index", "observation.state", "action").where(F.col("episode_index") == episode)
        if df.isEmpty():
            raise ValueError(f"no episode {episode}")
        return df.orderBy("frame_index")

    def bounds(self, episode: int) -> tuple[int, int]:
        """An episode's first index and the one after its last. Raises ValueError if there's no such episode."""
        r = self.index().where(F.col("episode_index") == episode).select("dataset_from_index", "dataset_to_index").first()
        if r is None:
            raise ValueError(f"no episode {episode}")
        return r[0], r[1]

    def first_frames(self) -> DataFrame:
        """Each episode's first frame."""
        df = self.frames()
        return df.groupBy("episode_index").agg(F.min_by(F.struct(*map(quoted, df.columns)), "frame_index").alias("f")).select("f.*")


def motor_names(feature: list | dict | None) -> list[str]:
    """Names of a feature's dimensions, given as a list or as {"motors": list}."""
    if isinstance(feature, dict):
        feature = feature.get("motors")
    return [str(x) for x in feature or []]
