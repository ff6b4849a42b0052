"""Landing-folder sources, the ledger cache, and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_VERSION = 4
PACKETS = "path string, modificationTime timestamp, length bigint, content binary"


def landing(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder with the SHA-256 of their bytes, which is the packet's identity."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("packet_hash"), "content")


def validated(files: DataFrame, extension: str = ".pdf") -> tuple[DataFrame, DataFrame]:
    """Accepted files, and the quarantine with its reason: nothing is dropped silently."""
    reason = F.when(~F.lower("path").endswith(extension), "WRONG_TYPE").when(F.col("length") == 0, "EMPTY_PACKET")
    marked = files.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def to_scan(packets: DataFrame, cache: DataFrame, version: int = LEDGER_VERSION) -> DataFrame:
    """Packets without a ledger of this version in the cache: only these are scanned."""
    return packets.join(cache.where(F.col("version") == version).select("packet_hash").distinct(), "packet_hash", "left_anti")


def with_cache(scanned: DataFrame, cache: DataFrame, version: int = LEDGER_VERSION) -> DataFrame:
    fresh = scanned.withColumn("cache_hit", F.lit(False))
    return cache.where(F.col("version") == version).drop("version").withColumn("cache_hit", F.lit(True)).unionByName(fresh)


def recovered(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pages with recovered text over the low-text ones. candidates: packet, page, text, confidence."""
    c = candidates.select("packet", "page", F.col("text").alias("new_text"), F.col("confidence").alias("new_confidence"))
    out = pages.join(c, ["packet", "page"], "left")
    use = F.col("needs_visual_review") & (F.coalesce("new_text", F.lit("")) != "")
    return out.select("packet", "page", F.when(use, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(use, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"), (F.col("needs_visual_review") & ~use).alias("needs_visual_review"))


def requested_pages(requests: DataFrame, budget: int = 80) -> DataFrame:
    """request, page, processed: page lists such as '3, 1,x,3' parsed, distinct, sorted; those past the budget
    are flagged. requests: request, pages."""
    from pyspark.sql import Window

    p = requests.select("request", F.explode(F.split("pages", ",")).alias("p")).select("request", F.trim("p").try_cast("int").alias("page")).where("page > 0").distinct()
    return p.withColumn("processed", F.row_number().over(Window.partitionBy("request").orderBy("page")) <= budget)


def model_output(raw: DataFrame, schema: str) -> DataFrame:
    """Stored model output parsed strictly: a row that does not fit the schema goes to `broken`."""
    out = raw.withColumn("parsed", F.from_json("json", schema, {"mode": "PERMISSIVE"}))
    return out.withColumn("broken", F.col("parsed").isNull())


def write_lines(lines: DataFrame, path: str, line: str = "line", separator: str = "\r\n") -> None:
    """Hand-built CSV lines through the text sink, which leaves line ends inside cells alone."""
    lines.select(line).write.mode("overwrite").option("lineSep", separator).text(path)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append-only logs (receipts, decisions, status events); readers keep the latest row of a key."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)
