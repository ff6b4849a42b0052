"""Token-id files: the ids of all documents in ascending doc_id order, as Simple-8b files that tasks write and read.

Documents are range-partitioned by id, so that files in the order of (part, seq) hold them in order; each task
encodes its documents and writes a file whenever FILE_IDS ids are gathered. A table of the files (part, seq,
name, counts) is written by Spark, so a task that was lost and ran again leaves at most a file that no row names.
Files are opened by pyarrow.fs, which takes local paths and the URIs of object stores and HDFS.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe, simple8b
from .common import arrow, modest_batches, partitions, shared_dir

#: A file ends with the document that reaches this many ids (about 9 MB).
FILE_IDS = 1 << 22
FILES = "part int, seq int, name string, n_docs long, n_ids long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Writes each row's ids (special tokens' strings in a text are these tokens) and end_id to files in folder,
    in ascending doc_id order (null ids first; rows of one id by the text's hash), and the table folder/files.

    Null and empty texts have end_id alone. Rows that repeat are all written. Rows that share an id, or have none,
    are dealt to many partitions too, since the order goes on by the text's hash and the row's number. Other
    columns are not read. An empty table gives no file and an empty table of files.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    vocabulary = vocabulary or byte_bpe.default_path()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"h": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "h", "nth").sortWithinPartitions("doc_id", "h", "nth").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = byte_bpe.coder(vocabulary), TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        seq, held, ids, keys = 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, ids, keys
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            sizes = np.array([len(x) for x in ids])
            valid = np.array([k is not None for k in keys])
            data = simple8b.to_bytes(np.array([k or 0 for k in keys], np.int64), valid, sizes, np.concatenate(ids))
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "n_docs": len(ids), "n_ids": int(sizes.sum())}], arrow(FILES))
            seq, held, ids, keys = seq + 1, 0, [], []
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.append(bpe.ids(text.as_py() or ""), np.uint32(end_id))
                keys.append(key)
                ids.append(got)
                held += len(got)
                if held >= FILE_IDS:
                    yield flush()
        if ids:
            yield flush()

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    ordered.mapInArrow(run, FILES).write.parquet(f"{folder}/files")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder with the number of ids before each (start): sums within a part, on top of the sums of
    the parts before it, of which there are as many as tasks wrote."""
    table = spark.read.parquet(f"{folder}/files")
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return table.withColumn("within", within).join(before, "part").select("part", "seq", "name", "n_docs", "n_ids", (F.col("before") + F.col("within")).alias("start"))


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) of every document in the files of a folder; with_ids adds the ids as array<long>."""
    listed = files(spark, folder).select("name", "start").repartition(partitions(spark), "name")
    schema = TOKENS + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as source:
                    doc_id, valid, sizes, packed = simple8b.from_bytes(source.read())
                ids = simple8b.unpack(packed)
                raw = memoryview(ids.astype("<u4").tobytes())
                end = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(doc_id, mask=~valid), pa.array(start + end - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow(schema))

    return listed.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids to a new folder of the shared folder and reads the files back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, vocabulary, end_id)
    return read_ids(spark, folder)
