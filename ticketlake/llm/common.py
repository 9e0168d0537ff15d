"""Helpers shared by the training-data operators.

Texts reach Python in Arrow batches; ``slices`` cuts a batch into runs of a
bounded number of bytes, so memory depends neither on the batch size nor on
the input (a single text longer than the bound is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.session import scratch_dir

SLICE_BYTES = 1 << 20
#: bound on memoised words or chunks in a Python worker
MEMO_LIMIT = 400_000

#: ASCII letters lower-cased, digits and non-ASCII bytes kept, all else a space.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
                   for b in range(256))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(np.asarray(size, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column with nulls as empty texts."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def record(like: pa.RecordBatch | None, keep: list[str], **columns) -> pa.RecordBatch:
    """A batch of columns kept from ``like`` and of new ones."""
    names, arrays = [], []
    for k in keep:
        names.append(k)
        arrays.append(like.column(like.schema.get_field_index(k)))
    for k, v in columns.items():
        names.append(k)
        arrays.append(v if isinstance(v, pa.Array) else pa.array(v))
    return pa.RecordBatch.from_arrays(arrays, names)


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


PIECE = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(max(n, PIECE + 2), np.uint64(base))
        p[0] = 1
        _POWERS[base] = np.cumprod(p)
    return _POWERS[base]


def run_hashes(buf: bytes, blank: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and lengths of the runs without the byte ``blank``.

    A run's polynomial is a difference of prefix sums, shifted to its start by
    the inverse power; pieces of the buffer end at blanks.
    """
    data = np.frombuffer(buf, np.uint8)
    found, starts, sizes, at = [], [], [], 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            end = buf.rfind(blank, at, at + PIECE)
            if end <= at:
                end = buf.find(blank, at + PIECE)
                end = len(data) if end < 0 else end
        piece = data[at:end]
        full = np.concatenate(([False], piece != blank, [False]))
        edge = np.flatnonzero(full[1:] != full[:-1])
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(piece))[:len(piece)], out=sums[1:])
        found.append(mix((sums[last] - sums[first]) * _powers(_P_INV, len(piece) + 1)[first]))
        starts.append(first + at)
        sizes.append(last - first)
        at = end + 1
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(starts), np.concatenate(sizes)


def joined(raws: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Buffers with a space behind each, and where each starts (and the end)."""
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))
    return b" ".join([*raws, b""]), np.concatenate(([0], ends))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, one after another,
    and each text's number of words."""
    buf, at = joined([t.lower().encode("utf-8") for t in texts])
    hashes, starts, _ = run_hashes(buf.translate(WORD_BYTES))
    return hashes, np.diff(np.searchsorted(starts, at))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written in the shared folder (computed once,
    unlike a checkpoint of a frame that isn't cached)."""
    spark = df.sparkSession
    path = scratch_dir(spark, "llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 4 << 20


def bounded(keys: DataFrame) -> DataFrame:
    """Rows of a few short columns for a join: broadcast if they take at most
    ``BROADCAST_BYTES`` (rows counted, a column at 48 bytes), else left to a shuffle."""
    most = BROADCAST_BYTES // (48 * len(keys.columns))
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def free_name(taken: list[str], name: str) -> str:
    """``name`` with underscores, so that no column (case ignored) has it."""
    lower = {t.lower() for t in taken}
    name = f"__{name}__"
    while name.lower() in lower:
        name = f"_{name}_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sampled_labels(labels: DataFrame, column: str, rows: int, learn_only: bool = False) -> DataFrame:
    """At most ``rows`` labelled documents: (doc_id, label), the first by a hash
    of doc_id. Repeated and contradicting labels fold to the smallest one."""
    lab = (labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)))
    if learn_only:
        lab = lab.where(~held_out("doc_id"))
    lab = lab.groupBy("doc_id").agg(F.min("label").alias("label"))
    return lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
