"""Export profiles as data: which columns, in what order, from which paths of a nested record, are rows of a table, so a
change of a profile is a change of rows. Records are read by path, whatever their nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from docketlab.functions import text as T

#: What stands for a missing value, and the states that a required field may have.
UNRESOLVED = "(?i)^needs review$|^unresolved$"
CONFIRMED, EXAMINER = "CONFIRMED", "EXAMINER_CONFIRMED"
COLUMNS = "profile string, ord int, key string, label string, path string, required boolean, foreclosure_only boolean, examiner boolean"


def leaves(col: Column, kind: DataType, path: str = "") -> list[tuple[str, Column]]:
    """(path, value as text) of every scalar of a nested value; arrays of scalars are joined by ' | '."""
    if isinstance(kind, StructType):
        return [leaf for f in kind.fields for leaf in leaves(col[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, ArrayType):
        scalar = not isinstance(kind.elementType, (StructType, ArrayType))
        return [(path, F.array_join(F.transform(col, lambda x: x.cast("string")), " | "))] if scalar else []
    return [(path, col.cast("string"))]


def by_path(records: DataFrame, record: str = "record") -> Column:
    """map<path, text> of the record's scalars; a path that the record has not is absent."""
    found = leaves(F.col(record), records.schema[record].dataType)
    return F.map_from_entries(F.array(*[F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in found]))


def merged(base: DataFrame, custom: DataFrame) -> DataFrame:
    """Columns of custom profiles: a client's required base columns first, then its own; of one key the own column, in the
    place of the first. base: client and COLUMNS without profile; custom: client and COLUMNS; clients meet without regard
    to case, and a client without a base has its own columns only."""
    c = F.col
    client = lambda df: F.lower(F.trim(df["client"]))
    rest = [n.split()[0] for n in COLUMNS.split(", ")[1:]]
    profiles = custom.select("profile", client(custom).alias("who")).distinct()
    first = base.where("required").select(client(base).alias("who"), *rest).join(profiles, "who").select("profile", F.lit(0).alias("own"), *rest)
    rows = first.unionByName(custom.select("profile", F.lit(1).alias("own"), *rest))
    best = rows.groupBy("profile", "key").agg(F.min(F.struct("own", "ord")).alias("at"), F.max_by(F.struct(*[n for n in rest if n != "key"]), F.struct("own", "ord")).alias("x"))
    place = F.row_number().over(Window.partitionBy("profile").orderBy("at", "key"))
    return best.select("profile", place.alias("ord"), "key", *[c(f"x.{n}").alias(n) for n in rest if n not in ("key", "ord")])


def values(records: DataFrame, columns: DataFrame, record: str = "record") -> DataFrame:
    """key, profile, ord, column, label, value, and whether the value is missing or unconfirmed: a row for each column of
    each record's profile. A record meets its profile's columns as one array (profiles are few: their rows are counted
    before they are sent to all tasks), and paths are looked up inside the row. records: key, profile, record."""
    c = F.col
    packed = columns.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "label", "path", "required", "foreclosure_only", "examiner"))).alias("columns"))
    sent = F.broadcast(packed) if columns.count() <= 100_000 else packed
    rows = records.select("key", "profile", by_path(records, record).alias("at")).join(sent, "profile").select("key", "profile", "at", F.explode("columns").alias("x"))
    value, state = F.try_element_at("at", c("x.path")), F.try_element_at("at", F.concat(c("x.path"), F.lit("_state")))
    order, order_state = F.try_element_at("at", F.lit("order_type")), F.try_element_at("at", F.lit("order_type_state"))
    foreclosure = F.coalesce((order_state == CONFIRMED) & (F.lower(order) == "foreclosure"), F.lit(False))
    asked = c("x.required") & (foreclosure | ~c("x.foreclosure_only"))
    text = F.trim(F.coalesce(value, F.lit("")))
    missing = (text == "") | text.rlike(UNRESOLVED)
    unsure = state.isNotNull() & (state != CONFIRMED) & ~(c("x.examiner") & (state == EXAMINER))
    problem = F.when(asked & missing, "MISSING").when(asked & unsure, "UNCONFIRMED")
    return rows.select("key", "profile", "x.ord", c("x.key").alias("column"), "x.label", value.alias("value"), state.alias("state"), problem.alias("problem"))


def lines(found: DataFrame) -> DataFrame:
    """key, line: one quoted CSV line a record, columns in the profile's order."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("ord", T.csv_cell(F.col("value")).alias("cell")))), lambda x: x["cell"])
    return found.groupBy("key").agg(F.array_join(cells, ",").alias("line"))


def objects(found: DataFrame) -> DataFrame:
    """key, json: one object a record, by column key, in the profile's order; missing values are null."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", "column", "value")))
    one = F.transform(pairs, lambda x: F.concat(F.to_json(F.array(x["column"])), F.lit(":"), F.to_json(F.array(x["value"]))))
    # each part is a one-element JSON array: its brackets go
    bare = F.transform(one, lambda s: F.regexp_replace(F.regexp_replace(s, "^\\[|\\]$", ""), "\\]:\\[", ":"))
    return found.groupBy("key").agg(F.concat(F.lit("{"), F.array_join(bare, ","), F.lit("}")).alias("json"))


def headers(columns: DataFrame) -> DataFrame:
    """profile, line: the labels of each profile."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("ord", T.csv_cell(F.col("label")).alias("cell")))), lambda x: x["cell"])
    return columns.groupBy("profile").agg(F.array_join(cells, ",").alias("line"))


def warnings(found: DataFrame) -> DataFrame:
    """key, column, message of each required field that is unresolved or not confirmed by its source."""
    name = F.concat(F.lit("required export field "), "label")
    said = F.when(F.col("problem") == "MISSING", F.concat(name, F.lit(" is unresolved."))).otherwise(F.concat(name, F.lit(" is not source-confirmed ("), "state", F.lit(").")))
    return found.where("problem is not null").select("key", "column", said.alias("message"))


def joined_text(rows: DataFrame, order: list[str], text: Column) -> DataFrame:
    """packet, text: a text of each of a packet's rows, in order, joined by ' | '."""
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return rows.groupBy("packet").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " | ").alias("text"))


def requirements_text(requirements: DataFrame, issues: DataFrame) -> DataFrame:
    """packet, text: requirements with their actions, then quality issues with theirs. requirements: packet, turn, type,
    title, action; issues: packet, turn, title, action."""
    said = lambda kind: F.concat(kind, F.lit(": "), "title", F.lit(" ACTION: "), "action")
    a = requirements.select("packet", F.lit(0).alias("part"), "turn", said(F.col("type")).alias("said"))
    b = issues.select("packet", F.lit(1).alias("part"), "turn", said(F.lit("QC/CURE")).alias("said"))
    return joined_text(a.unionByName(b), ["part", "turn"], F.col("said"))


def audit_text(areas: DataFrame) -> DataFrame:
    """packet, text: label, status and summary of each area. areas: packet, turn, label, status, summary."""
    return joined_text(areas, ["turn"], F.concat("label", F.lit(" — "), "status", F.lit(": "), "summary"))
