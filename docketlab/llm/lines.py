"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line goes when the same line, or one within EDITS edits, stands earlier in the corpus (by doc_id, then line
number). Each distinct line is cut into EDITS + 1 segments: two lines within EDITS edits agree in one of
them. Segments are indexed by their number, the line's length and a hash; a line probes, for each possible
length of the other line and each segment, only the start positions where a matching segment can lie. What
meets is sifted by letter counts inside the join, and verified by a banded bit-parallel automaton
over the part left after the common beginning and end.

Every line that is not blank goes where the same line stands earlier; lines under MIN_CHARS characters are never
near another, as two edits make a short line another one. Blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NULL_ID, safe_key, semi, sized, stored

EDITS, MIN_CHARS = 2, 32
#: Letters whose counts sift candidates; texts without them are sifted less, not wrongly.
LETTERS = "etnaorhsildcumgp"
BLANK = " \t\n\x0b\f\r"


def segment(i: Column, length: Column, edits: int) -> tuple[Column, Column]:
    """First position (from 1) and size of segment i of edits + 1 near-equal ones, the longer ones last."""
    k = edits + 1
    base, short = F.floor(length / k).cast("int"), k - (length % k)
    return 1 + i * base + F.greatest(F.lit(0), i - short), base + F.when(i >= short, 1).otherwise(0)


def _key(i: Column, length: Column, line: Column, n: Column, start: Column, size: Column) -> Column:
    """Hash of a segment's number, its line's length and its bytes. Bytes of ASCII lines are cut out directly;
    finding a character of other lines means walking there."""
    part = F.when(F.octet_length(line) == n, F.substring(line.cast("binary"), start, size)).otherwise(F.substring(line, start, size).cast("binary"))
    return F.xxhash64(i, length.cast("int"), part)


def keyed(rows: DataFrame, edits: int, probes: bool) -> DataFrame:
    """side, h, c, key of each line (line, h, n, c): its own segments (the index, side 0), or, as probes, on side
    1 + d all segments that a line shorter by d within `edits` edits could share with it.

    With the other line shorter by d, segment i (from 0) can start at offset o from its own place only where
    |o| <= i and |o - d| <= edits - i: fewer edits lie before it than it has predecessors, and likewise after.
    One row per place comes first, so that the generated code for a key stays small.
    """
    places = [(1 + d, d, i, o) for d in range(edits + 1) for i in range(edits + 1) for o in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]
    places = places if probes else [(0, 0, i, 0) for i in range(edits + 1)]
    each = rows.select("h", "c", "line", "n", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("sdio", p, strict=True)]) for p in places])).alias("t"))
    other = F.col("n") - F.col("t.d")
    start, size = segment(F.col("t.i"), other, edits)
    at = start + F.col("t.o")
    fits = (at >= 1) & (at + size - 1 <= F.col("n"))
    return each.where(fits).select(F.col("t.s").alias("side"), "h", "c", _key(F.col("t.i"), other, F.col("line"), F.col("n"), at, size).alias("key"))


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS occurs, modulo 16, four bits each. An edit moves at most two of the counts by
    one, so the counts of lines within k edits differ by at most 2k in sum, and less around the circle of 16."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(15))
        out = out.bitwiseOR(F.shiftleft(count.cast("long"), 4 * k))
    return out


def _alike(a: Column, b: Column, edits: int, longer: Column) -> Column:
    """Where b is longer by so many characters, as many edits only add one, and move one count by one."""
    four = lambda c, k: F.shiftrightunsigned(c, 4 * k).bitwiseAND(F.lit(15))
    off = F.lit(0)
    for k in range(len(LETTERS)):
        d = F.abs(four(a, k) - four(b, k))
        off = off + F.least(d, 16 - d)
    return off <= 2 * edits - longer


def _common(a: Column, b: Column, least: Column, end: bool) -> Column:
    """Length of the common beginning (or end) of a and b, at most `least`, by binary search."""
    part = F.right if end else F.left
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= least) & (part(a, n + s) == part(b, n + s)), n + s).otherwise(n))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether arrays of characters a and b are within `edits` edits: a banded bit-parallel automaton.

    State e is a bit set over the 2 * edits + 1 diagonals of the band: bit o is set when a prefix of a that is
    o - edits longer than the read prefix of b matches it with e edits. Reading a character keeps the
    diagonals where characters match; a replaced character keeps a diagonal at one edit more, an extra one
    in b moves it down, an extra one in a moves it up.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def closed(states: list[Column]) -> list[Column]:
        out = [states[0]]
        for s in states[1:]:
            out.append(s.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(mask)))
        return out

    names = [f"s{e}" for e in range(edits + 1)]

    def advance(acc: Column, j: Column) -> Column:
        c = F.get(b, j)
        match = F.lit(0)
        for o in range(width):
            at = j + (o - edits)
            match = match.bitwiseOR(F.when((at >= 0) & (F.get(a, F.greatest(at, F.lit(0))) == c), F.lit(1 << o)).otherwise(F.lit(0)))
        old = [acc[n] for n in names]
        new = [old[0].bitwiseAND(match)]
        for e in range(1, edits + 1):
            new.append(old[e].bitwiseAND(match).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)))
        alive = old[0].bitwiseOR(old[1]).bitwiseOR(old[-1]) != 0 if edits else old[0] != 0
        return F.when(alive, F.struct(*[s.alias(n) for s, n in zip(closed(new), names, strict=True)])).otherwise(acc)

    start = closed([F.lit(1 << edits)] + [F.lit(0)] * edits)
    steps = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(steps, F.struct(*[s.alias(n) for s, n in zip(start, names, strict=True)]), advance)
    goal = F.size(a) - F.size(b) + edits
    any_state = end[names[0]]
    for n in names[1:]:
        any_state = any_state.bitwiseOR(end[n])
    return (goal >= 0) & (goal < width) & (F.call_function("shiftright", any_state, F.greatest(goal, F.lit(0))).bitwiseAND(F.lit(1)) == 1)


def _lines(docs: DataFrame) -> DataFrame:
    """_k, pos, line of the lines that are not blank."""
    return docs.select("_k", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.btrim("line", F.lit(BLANK)) != "")


def first_places(docs: DataFrame) -> DataFrame:
    """h (line hash), at (its first place: key and line number) and n (occurrences) of every line that is not blank."""
    return _lines(docs).groupBy(F.xxhash64("line").alias("h")).agg(F.min(F.struct("_k", "pos")).alias("at"), F.count("*").alias("n"))


def distinct_lines(docs: DataFrame, firsts: DataFrame, min_chars: int) -> DataFrame:
    """line, h, n of every distinct line of min_chars or more, read at its first place. Only lines that occur more
    than once have to be looked up; they are broadcast while they are few, so that texts need not move."""
    repeated = sized(stored(firsts.where("n > 1").select("h", "at"), "repeated"))
    every = _lines(docs).where(F.length("line") >= min_chars).withColumn("h", F.xxhash64("line"))
    first = every.join(repeated, "h", "left").where(F.col("at").isNull() | (F.col("at") == F.struct("_k", "pos")))
    return first.select("line", "h", F.length("line").alias("n"))


def near_pairs(signed: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b: hashes of distinct lines (line, h, n, c) that share a segment and may be within `edits` edits, once each."""
    index, probe = keyed(signed, edits, False).alias("i"), keyed(signed, edits, True).alias("p")
    met = index.join(probe, (F.col("i.key") == F.col("p.key")) & (F.col("i.h") != F.col("p.h")) & ((F.col("p.side") > 1) | (F.col("p.h") > F.col("i.h"))) & _alike(F.col("i.c"), F.col("p.c"), edits, F.col("p.side") - 1))
    return met.select(F.least("i.h", "p.h").alias("a"), F.greatest("i.h", "p.h").alias("b")).distinct()


def verify(pairs: DataFrame, signed: DataFrame, edits: int = EDITS) -> DataFrame:
    """The pairs whose lines really are within `edits` edits. Rows that share a key may hold a line twice at its
    first place; one of them is read."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    text = stored(semi(signed, stored(ends, "ends"), "h").select("h", "line").dropDuplicates(["h"]), "texts")
    both = pairs.join(text.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(text.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    both = both.withColumn("least", F.least(F.length("x"), F.length("y")))
    both = both.withColumn("head", _common(F.col("x"), F.col("y"), F.col("least"), False))
    both = both.withColumn("tail", _common(F.col("x"), F.col("y"), F.col("least") - F.col("head"), True))
    cut = lambda c: F.split(F.substring(c, F.col("head") + 1, F.length(c) - F.col("head") - F.col("tail")), "")
    chars = lambda c: F.filter(cut(F.col(c)), lambda s: s != "")
    # written once: the filter below would else carry these expressions into every step of its fold
    rest = stored(both.select("a", "b", chars("x").alias("x"), chars("y").alias("y")), "candidates")
    return rest.where(within(F.col("x"), F.col("y"), edits)).select("a", "b")


def line_decisions(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """drops array<struct<pos, h, near>>, the lines that go, per key _k of docs (_k, text).

    A line at its first place goes only if a near line's first place is earlier; elsewhere it always goes."""
    firsts = stored(first_places(docs), "lines")
    # read twice below, as index and as probes
    signed = stored(distinct_lines(docs, firsts, min_chars).select("line", "h", "n", letter_counts(F.col("line")).alias("c")), "distinct")
    pairs = stored(near_pairs(signed, edits), "linepairs")
    near = verify(pairs, signed, edits)
    place = firsts.select("h", "at")
    ends = near.join(place.select(F.col("h").alias("a"), F.col("at").alias("pa")), "a").join(place.select(F.col("h").alias("b"), F.col("at").alias("pb")), "b")
    later = stored(ends.where("pa <> pb").select(F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("h")).distinct(), "later")
    # lines to judge: those that occur twice, and those near an earlier one
    judged = firsts.join(later.withColumn("near", F.lit(True)), "h", "left").where("n > 1 or near").select("h", "at", F.coalesce("near", F.lit(False)).alias("near"))
    judged = sized(stored(judged, "judged"))
    here = _lines(docs).select("_k", "pos", F.xxhash64("line").alias("h"))
    gone = here.join(judged, "h").where(F.col("near") | (F.struct("_k", "pos") > F.col("at")))
    drops = stored(gone.groupBy("_k").agg(F.collect_set(F.struct("pos", "h", "near")).alias("drops")), "drops")
    # a document's list is broadcast only while all lists together are few entries
    few = (drops.agg(F.sum(F.size("drops"))).first()[0] or 0) <= BROADCAST_ROWS
    return F.broadcast(drops) if few else drops.hint("shuffle_hash")


def deduped(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text replaced, and n_lines, n_dropped, n_near (dropped for a line that is not the same), emptied.

    A null text stays null with 0 lines. Rows that share a doc_id hold one place: the same line at the same
    number in them is one occurrence, so repeated rows lose the same lines. Null ids share one place, before
    all others. Other columns pass through, whatever their names; those named like the four counts are replaced.
    """
    made = ("n_lines", "n_dropped", "n_near", "emptied")
    names = [c for c in docs.columns if c not in made]
    # the caller's columns travel as one, so that none meets a column of this function
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_row") if len(names) > 1 else F.lit(None).alias("_row"), safe_key(F.col("doc_id")).alias("_k"), "text")
    drops = line_decisions(rows.select("_k", "text"), edits, min_chars)
    out = rows.join(drops, "_k", "left")
    lines = F.split("text", "\n")
    gone = F.coalesce(F.col("drops"), F.array().cast("array<struct<pos:int,h:bigint,near:boolean>>"))
    mine = F.filter(gone, lambda d: (d["pos"] < F.size(lines)) & (F.xxhash64(F.get(lines, d["pos"])) == d["h"]))
    out = out.withColumn("_gone", F.when(F.size(gone) > 0, mine).otherwise(gone))
    where = F.transform("_gone", lambda d: d["pos"])
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(where, i)), "\n")
    counts = [F.coalesce(F.size(lines), F.lit(0)), F.size("_gone"), F.size(F.filter("_gone", lambda d: d["near"])), F.size("_gone") == F.coalesce(F.size(lines), F.lit(0))]
    text = F.when(F.size("_gone") > 0, kept).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names], *[v.alias(c) for c, v in zip(made, counts, strict=True)])


__all__ = ["NULL_ID", "deduped", "line_decisions", "within"]
