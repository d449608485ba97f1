"""Helpers that the corpus operators share: shared scratch tables, bounded broadcasts, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tabulon

# Functions sent to executors carry their code along, so that workers need not have the package on their path.
cloudpickle.register_pickle_by_value(tabulon)

#: Words are runs of anything but ASCII white space (space and 0x09 to 0x0D).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset a temporary one on a local master (tests), whose
    executors share it, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="tabulon-")).as_uri()
        spark.sparkContext.setCheckpointDir(found)
    return found


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tabulon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: list[str], salt=None, how: str = "inner", limit: int = 100_000, copies: int = 64) -> DataFrame:
    """Join a table that is expected to be small: broadcast it up to `limit` rows (counted first), else
    join by key with each key of `big` spread over `copies` salts and `small` repeated for each (1: a plain join)."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    if copies == 1:
        return big.join(small, on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return big.withColumn("__salt", F.pmod(salt, F.lit(copies)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each row's bounds in them; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    bounds = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    return data[bounds[0] : bounds[-1]] if len(col) else data[:0], bounds - (bounds[0] if len(bounds) else 0)


def texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; a null counts as empty."""
    return pc.fill_null(col, "").cast(pa.large_binary()).to_pylist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Texts are looked at in groups of about so many bytes, so that a task's arrays stay small.
GROUP_BYTES = 4 << 20


def byte_groups(bounds: np.ndarray, size: int = GROUP_BYTES):
    """Ranges of rows of about `size` bytes; a longer row stands alone."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, last
        first = last


#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i in 0..n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n + 1, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a finaliser of xors and multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, pows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, whatever its place."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * pows[0][: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * pows[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in concatenated texts, and the first word of each text (one more at the end)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # words that run from one text into the next are cut between them
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, bounds)
