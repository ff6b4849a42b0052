"""Shared plumbing of the training-data operators: shared-folder tables, hashing, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows with these remainders of crc32(text of doc_id) are held out from learning.
FOLDS_LABELS, FOLDS_LM = 5, 10
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a session on this machine alone gets a
    temporary one; on a cluster no other machine could read that, so there it is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="docketlab-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df written once as Parquet in the shared folder, and reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of one long that may be broadcast (about 16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def semi(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """docs whose key is among ids (a stored table of one long): ids are counted first, and are broadcast only
    under BROADCAST_ROWS, so that texts need not move; beyond it both sides shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("shuffle_hash"), on, "left_semi")


def sized(df: DataFrame) -> DataFrame:
    """A stored table of short rows, marked for broadcast if it is counted under BROADCAST_ROWS; beyond that the
    join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


#: Rows of an Arrow batch: texts are long, and both sides of the pipe hold a batch.
ARROW_ROWS = 2000


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ARROW_ROWS, if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def safe_key(col: Column) -> Column:
    """A join key that keeps null ids: they share one reserved value."""
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the n+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
_LOWER[_SEPARATOR] = 0
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            t = np.full(n + 1, base, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def words(data: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """Words `[^\\x20\\x09-\\x0D]+` of the rows data[off[i]:off[i+1]], A-Z lower-cased.

    Returns start and end (byte positions in data), row, and a 64-bit hash of each word. A hash is a
    polynomial over the word's bytes modulo 2**64, read off one running sum over all bytes, then mixed. With
    prefixes, a fifth value has for each length the rows and hashes of the beginnings of longer words.
    """
    lo, hi = int(off[0]), int(off[-1])
    part = data[lo:hi]
    if not len(part):
        z = np.zeros(0, np.int64)
        none = z, z, z, np.zeros(0, np.uint64)
        return (*none, [(z, none[3])] * len(prefixes)) if prefixes else none
    gap = _SEPARATOR[part]
    first = np.empty(len(part), bool)
    first[0] = True
    first[1:] = gap[:-1]
    rows = off[:-1][off[1:] > off[:-1]] - lo
    first[rows] = True
    first &= ~gap
    last = np.empty(len(part), bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[rows[1:] - 1] = True
    last &= ~gap
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(part))
    total = np.empty(len(part) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWER[part] * power[: len(part)], out=total[1:])
    h = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(off, start + lo, side="right") - 1
    if not prefixes:
        return start + lo, end + lo, row, h
    stems = []
    for k in prefixes:
        at = np.flatnonzero(end - start > k)
        s = start[at]
        stems.append((row[at], mix64((total[s + k] - total[s]) * inverse[s] + np.uint64(k << 32))))
    return start + lo, end + lo, row, h, stems


def blocks(off: np.ndarray, size: int = 1 << 20):
    """Row ranges (i, j) of about `size` bytes each; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}


def arrow(schema: str) -> pa.Schema:
    """Arrow schema of a DDL string of plain types; usable in workers, which have no session."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])
