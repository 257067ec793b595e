"""Container files (message logs, bags, trees, video) as tables, by a decoder per format.

A decoder takes a file's bytes and yields rows. The libraries for the formats aren't part of this package; `decoder(kind)` finds one
that is installed, and any function may be given instead. A file that can't be read is a row of `unreadable`, not a failed job."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Libraries by kind.
LIBRARIES = {"mcap": "mcap", "bag": "rosbags", "tree": "h5py", "video": "av"}


class MissingReader(ImportError):
    """No library for this kind of file is installed."""


def log_rows(data: bytes) -> Iterator[tuple]:
    """(topic, schema, encoding, log_time, seq, payload) of an MCAP file."""
    import io

    from mcap.reader import make_reader

    for schema, channel, message in make_reader(io.BytesIO(data)).iter_messages():
        yield channel.topic, schema.name if schema else None, channel.message_encoding, message.log_time, message.sequence, message.data.decode("utf-8", "replace")


def tree_rows(data: bytes) -> Iterator[tuple]:
    """(name, shape, dtype, chunks, compression) of each dataset of an HDF5 file."""
    import io

    import h5py

    out: list[tuple] = []
    with h5py.File(io.BytesIO(data)) as f:
        f.visititems(lambda name, x: out.append((name, str(x.shape), str(x.dtype), str(x.chunks), x.compression)) if hasattr(x, "shape") else None)
    yield from out


def video_times(data: bytes) -> Iterator[tuple]:
    """(t,) of each frame, decoded once from the file's begin."""
    import io

    import av

    with av.open(io.BytesIO(data)) as container:
        for frame in container.decode(video=0):
            yield (float(frame.time),)


SCHEMAS = {
    "mcap": "topic string, schema string, encoding string, log_time long, seq long, payload string",
    "tree": "name string, shape string, dtype string, chunks string, compression string",
    "video": "t double",
}
DECODERS = {"mcap": log_rows, "tree": tree_rows, "video": video_times}


def decoder(kind: str) -> Callable[[bytes], Iterator[tuple]]:
    if kind not in DECODERS or importlib.util.find_spec(LIBRARIES[kind]) is None:
        raise MissingReader(f"no reader for {kind!r} is installed; give read() a decoder of your own")
    return DECODERS[kind]


def read(spark: SparkSession, path: str, schema: str, decode: Callable[[bytes], Iterator[tuple]]) -> tuple[DataFrame, DataFrame]:
    """The rows of all files under `path` (with the file's `path`), and the files that couldn't be read (path, error). One task reads whole files."""
    own = T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType()), *T.StructType.fromDDL(schema).fields])
    names = own.names

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                try:
                    out = [(name, None, *r) for r in decode(bytes(data))]
                except Exception as x:  # noqa: BLE001 whatever a decoder finds wrong
                    out = [(name, f"{type(x).__name__}: {x}", *[None] * (len(names) - 2))]
                if out:
                    yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    told = files.mapInPandas(rows, own)
    return told.where("error is null").drop("error"), told.where("error is not null").select("path", "error")
