import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from pyspark.sql import SparkSession  # noqa: E402

AT = dt.datetime(2024, 3, 5)
FRAMES = "episode_index long, frame_index long, task_index long, timestamp float, action array<float>, `observation.state` array<float>, robot string, ingested_at timestamp_ntz"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.codegen.wholeStage", "false")  # on a few rows, compiling takes longer than running
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def write(spark, tmp_path):
    """Writes tables {name: (rows, schema)} and gives the folder."""

    def to(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return to


@pytest.fixture
def run(spark, write):
    """The rows of a registered query over the given tables."""

    def query(name, **tables):
        import __spark_entry__ as entry

        return [tuple(r) for r in entry.queries()[name](spark, write(**tables)).collect()]

    return query


def frame(episode, i, task=1, t=0.0, action=None, robot="007", at=AT, state=None):
    return (episode, i, task, t, action, state, robot, at)
