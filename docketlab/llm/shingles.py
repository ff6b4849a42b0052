"""N-gram Jaccard join by vertical partitioning.

The distinct 5-word shingles of a document are ordered by one global order (rarer frequency classes first,
then hash) and that order is cut into fragments. Documents that reach the threshold must share a shingle in
the first part of both their orders (the prefix), which gives candidates; for those, each fragment's overlap
is counted separately and the counts are summed per pair.

Documents with equal shingle sets form one class and only its first document takes part. Links are first
sought from every document to one centre per shared shingle (a list of k documents gives k - 1 pairs), then
between documents that these links have not connected. The second search is complete: it looks at every
shared prefix shingle of documents in different components and drops only pairs whose lengths, or whose
parity sketches (a lower bound of the symmetric difference), prove them unlike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, arrow, blocks, mix64, modest_batches, partitions, safe_key, semi, stored, utf8, words
from .components import components

WIDTH, NUM, DEN = 5, 80, 100
#: Slots of the frequency table: its size does not depend on the input.
SLOTS, SLICE = 1 << 18, 1 << 12
FRAGMENTS = 8
#: Documents of one shingle that are compared in one piece; longer lists are cut into pairs of blocks.
BLOCK = 4096
SETS = "doc_id long, n int, cls long, items binary"
PREFIX = "h long, cls long, n int, rare int"
PAIRS = "a long, b long, n1 int, n2 int, far int"
PARTS = "cls long, part int, items binary"


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of each row, sorted by row and hash."""
    _, _, row, h = words(data, off)
    n = len(off) - 1
    count = np.bincount(row, minlength=n)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        roll = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            roll = roll * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k] if len(roll) else roll
        full = mix64(roll)
        owner = row[: len(full)]
        ok = owner == row[width - 1 :] if len(full) else np.zeros(0, bool)
        rows, items = owner[ok], full[ok]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):  # the whole sequence of a short text is its one shingle
            start = np.searchsorted(row, short)
            s = np.full(len(short), 0x51, np.uint64)
            for k in range(width - 1):
                has = count[short] > k
                s[has] = s[has] * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(start + k, len(h) - 1)][has]
            rows, items = np.r_[rows, short], np.r_[items, mix64(s + count[short].astype(np.uint64))]
    order = np.lexsort((items, rows))
    rows, items = rows[order], items[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])
    return rows[keep], items[keep]


def _batches(batch: pa.RecordBatch, width: int):
    data, off = utf8(batch.column(1))
    for i, j in blocks(off):
        rows, items = shingle_sets(data, off[i : j + 1], width)
        yield i, j, rows, items


def _class_ids(rows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have shingles, their set sizes, and a 64-bit id of each set (two sums over its hashes)."""
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    n = np.diff(np.r_[at, len(rows)])
    twice = mix64(np.add.reduceat(items, at)) + np.add.reduceat(mix64(items ^ np.uint64(0xA5A5A5A5)), at)
    return rows[at], n, mix64(twice + n.astype(np.uint64)).view(np.int64)


def set_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), the set's 64-bit id and its parity sketch, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, rows, items in _batches(b, width):
                n, cls = np.zeros(j - i, np.int32), np.zeros(j - i, np.int64)
                sketch = np.array([b""] * (j - i), object)
                if len(rows):
                    own, size, ids = _class_ids(rows, items)
                    n[own], cls[own] = size, ids
                    sketch[own] = sketches(items, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(cls), pa.array(sketch, pa.binary())], schema=arrow(SETS))

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def frequency_classes(docs: DataFrame, width: int = WIDTH) -> bytes:
    """The bit length of the number of documents' shingles in each of SLOTS hash slots, over all documents.

    Each partition sends its table in slices; slices are summed by key. The result has SLOTS bytes whatever
    the input. Slots only steer the order, so shingles that share one are still told apart.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.int64)
        for b in batches:
            for *_, items in _batches(b, width):
                table += np.bincount((items >> np.uint64(46)).astype(np.int64), minlength=SLOTS)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS // SLICE), pa.int32()), pa.array([t.tobytes() for t in table.astype(np.int64).reshape(-1, SLICE)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(c, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])

    per_task = docs.select("doc_id", "text").mapInArrow(count, "slice int, counts binary")
    summed = per_task.repartition(min(partitions(docs.sparkSession), SLOTS // SLICE), "slice").mapInArrow(add, "slice int, counts binary")
    table = np.zeros(SLOTS, np.int64)
    for r in summed.collect():  # SLOTS / SLICE rows of fixed size
        table[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return np.ceil(np.log2(table + 1)).astype(np.uint8).tobytes()


def _ordered(rows: np.ndarray, items: np.ndarray, classes: np.ndarray):
    """Items in the global order within each row, their classes, first positions and sizes."""
    level = classes[(items >> np.uint64(46)).astype(np.int64)]
    order = np.lexsort((items, level, rows))
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return items[order], level[order], at, np.diff(np.r_[at, len(rows)])


def prefixes(docs: DataFrame, classes: bytes, num: int, den: int, width: int = WIDTH) -> DataFrame:
    """h, cls, n, rare: the first n - ceil(n * num / den) + 1 shingles of each text's order; rare is the
    number of its shingles in the lowest classes, least for the original among edited copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes, np.uint8)
        base = int(np.median(table)) + 1
        for b in batches:
            for _, _, rows, items in _batches(b, width):
                if not len(rows):
                    continue
                _, _, cls_id = _class_ids(rows, items)
                items, level, at, n = _ordered(rows, items, table)
                rare = np.add.reduceat((level <= base).astype(np.int32), at)
                pos = np.arange(len(rows)) - np.repeat(at, n)
                take = pos < np.repeat(n - -(-n * num // den) + 1, n)
                cols = [items[take].view(np.int64), np.repeat(cls_id, n)[take], np.repeat(n, n)[take].astype(np.int32), np.repeat(rare, n)[take].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=arrow(PREFIX))

    return docs.select("doc_id", "text").mapInArrow(run, PREFIX)


def fragments(docs: DataFrame, parts: int = FRAGMENTS, width: int = WIDTH) -> DataFrame:
    """cls, part, items: each text's sorted shingles, cut where pivots lie (equal ranges of the hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - int(np.log2(parts)))
        for b in batches:
            for _, _, rows, items in _batches(b, width):
                if not len(rows):
                    continue
                _, n, cls_id = _class_ids(rows, items)
                key = rows * parts + (items >> shift).astype(np.int64)
                at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                raw = items.tobytes()
                seg = [raw[8 * s : 8 * e] for s, e in zip(at, np.r_[at[1:], len(rows)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls_id, n)[at]), pa.array((key[at] % parts).astype(np.int32)), pa.array(seg, pa.binary())], schema=arrow(PARTS))

    return docs.select("doc_id", "text").mapInArrow(run, PARTS)


def sketch_words(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits in the sketch of a set of n: the power of two with at least two bits an item."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(n / 32, 2))).astype(np.int64)


def sketches(items: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each of the sets that follow one another in items (sizes n): the parity of the number of its items
    in each of 64 * sketch_words(n) slots, one bit a slot. The bits in which two sketches differ are at most
    the items in which the sets differ; halves of a sketch may be added bit by bit to fit a smaller one."""
    bits = 64 * sketch_words(n)
    base = np.r_[0, np.cumsum(bits)]
    slot = (mix64(items) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], n)
    raw = np.packbits((np.bincount(slot, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[i // 8 : j // 8] for i, j in zip(base[:-1], base[1:], strict=True)]


def _fold(sk: np.ndarray, width: int) -> np.ndarray:
    while sk.shape[-1] > width:
        half = sk.shape[-1] // 2
        sk = sk[..., :half] ^ sk[..., half:]
    return sk


def _differ(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    width = min(s1.shape[-1], s2.shape[-1])
    return np.bitwise_count(_fold(s1, width) ^ _fold(s2, width)).sum(-1).astype(np.int64)


def _may_link(n1: np.ndarray, n2: np.ndarray, s1: np.ndarray, s2: np.ndarray, num: int, den: int) -> np.ndarray:
    """False only where lengths or sketches (of one width each side) prove Jaccard < num / den."""
    # J >= t  <=>  |x ^ y| * (1 + t) <= (|x| + |y|) * (1 - t)
    return (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & (_differ(s1, s2) * (den + num) <= (n1 + n2) * (den - num))


def _pairs_of(n: np.ndarray, comp: np.ndarray, sk: list[bytes], left: np.ndarray, right: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions x in left and y in right (None: two of left, x < y) that may link and lie in
    different components. Rows are compared with rows of one sketch width at a time."""
    a, b = [], []
    width = np.array([len(s) for s in sk]) // 8
    same = right is None
    right = left if right is None else right
    for w in np.unique(width[right]):
        ys = right[width[right] == w]
        table = np.frombuffer(b"".join([sk[y] for y in ys]), np.uint64).reshape(-1, w)
        for x in left:
            ok = (comp[ys] != comp[x]) & (np.minimum(n[ys], n[x]) * den >= np.maximum(n[ys], n[x]) * num)
            if same:
                ok &= ys > x
            if ok.any():
                own = np.frombuffer(sk[x], np.uint64)
                at = np.flatnonzero(ok)
                at = at[_may_link(n[x], n[ys[at]], own, table[at], num, den)]
                a.append(np.full(len(at), x))
                b.append(ys[at])
    z = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (z, z)


def shared_prefixes(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct rows of prefix that share their shingle with a class of a size that allows a link; one shuffle.

    Rows arrive sorted by shingle, size and class, so the nearest sizes are neighbours. Only one row is held
    back, so a shingle of any number of documents passes in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sent = np.zeros((0, 4), np.int64), False  # the row before this batch, and whether it is out
        for b in batches:
            if not b.num_rows:
                continue
            had = len(last) > 0 and sent
            t = np.concatenate([last, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)])
            t = t[np.r_[True, (t[1:, :3] != t[:-1, :3]).any(1)]]
            same = (t[1:, 0] == t[:-1, 0]) & (t[:-1, 2] * den >= t[1:, 2] * num)
            emit = np.r_[False, same] | np.r_[same, False]
            last, sent = t[-1:], bool(emit[-1]) or (had and len(t) == 1)
            if had:
                emit[0] = False
            out = t[emit]
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int32)), pa.array(out[:, 3].astype(np.int32))], schema=arrow(PREFIX))

    n = partitions(prefix.sparkSession)
    return prefix.repartition(n, "h").sortWithinPartitions("h", "n", "cls").mapInArrow(run, PREFIX)


def _star(lists: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: each document of a shared shingle with the list's first (fewest rare shingles) and with the one
    before it, where lengths allow a link."""
    w = Window.partitionBy("h").orderBy("rare", "n", "cls")
    me = F.struct("cls", "n")
    near = lists.select("cls", "n", F.first(me).over(w).alias("centre"), F.lag(me).over(w).alias("before"))
    near = near.select("cls", "n", F.explode(F.array_distinct(F.array("centre", "before"))).alias("o")).where("o is not null and o.cls <> cls")
    near = near.where(F.least("n", "o.n") * den >= F.greatest("n", "o.n") * num)
    return near.select(F.least("cls", "o.cls").alias("a"), F.greatest("cls", "o.cls").alias("b")).distinct()


def _across(lists: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: pairs of one shared shingle in different components which lengths and sketches do not rule out.

    Lists are dealt out in blocks of about BLOCK documents, one group per pair of blocks, so no task holds an
    unbounded list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(t: pa.Table):
            key = np.stack([t.column(c).to_numpy() for c in ("h", "i", "j")], 1)
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
            cls, n, comp, blk = (t.column(c).to_numpy().astype(np.int64) for c in ("cls", "n", "comp", "blk"))
            sk = t.column("items").to_pylist()
            got = []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if (comp[s:e] != comp[s]).any():
                    at = np.arange(s, e)
                    left, right = (at, at) if key[s, 1] == key[s, 2] else (at[blk[at] == key[s, 1]], at[blk[at] == key[s, 2]])
                    x, y = _pairs_of(n[s:e], comp[s:e], sk[s:e], left - s, right - s if left is not right else None, num, den)
                    got.append(np.stack([cls[x + s], cls[y + s]], 1))
            if got:
                pairs = np.unique(np.sort(np.concatenate(got), 1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow("a long, b long"))
            return None

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            h, i, j = (t.column(c).to_numpy() for c in ("h", "i", "j"))
            end = len(h) - 1
            whole = np.flatnonzero((h != h[end]) | (i != i[end]) | (j != j[end]))
            at = whole[-1] + 1 if len(whole) else 0
            if at and (got := emit(t.slice(0, at))) is not None:
                yield got
            held = t.slice(at).combine_chunks()
        if held is not None and held.num_rows and (got := emit(held)) is not None:
            yield got

    count = lists.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h", "c")
    dealt = (
        lists.join(count, "h")
        .withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int"))
        .withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("h", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "cls", "n", "comp")
        .join(sets.select("cls", "items"), "cls")
        .select("h", "i", "j", "blk", "cls", "n", "comp", "items")
    )
    n = partitions(lists.sparkSession)
    return dealt.repartition(n, "h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, "a long, b long").distinct()


def sifted(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, n1, n2 of the pairs whose sketches do not rule a link out, and far: the least share of both sets'
    shingles that lie in one of them alone, by the sketches, in thousandths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2 = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            s1, s2 = (b.column(k).to_pylist() for k in (4, 5))
            ok, far, w = np.zeros(len(n1), bool), np.zeros(len(n1), np.int32), np.stack([sketch_words(n1), sketch_words(n2)], 1)
            for p, q in np.unique(w, axis=0):
                at = np.flatnonzero((w == (p, q)).all(1))
                x, y = (np.frombuffer(b"".join([s[i] for i in at]), np.uint64).reshape(len(at), -1) for s in (s1, s2))
                ok[at] = _may_link(n1[at], n2[at], x, y, num, den)
                far[at] = 1000 * _differ(x, y) // (n1[at] + n2[at])
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in (*b.columns[:4], pa.array(far))], schema=arrow(PAIRS))

    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("n1"), F.col("items").alias("s1")), "a").join(sets.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("items").alias("s2")), "b")
    return both.select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(run, PAIRS)


def cut_sets(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """The fragments (cls, part, items) of all sets that pairs name, stored."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    ids = stored(firsts.join(wanted, "cls").select("doc_id").distinct(), "wanted")
    return stored(fragments(semi(docs, ids, "doc_id"), FRAGMENTS, width).dropDuplicates(["cls", "part"]), "fragments")


def verified(pairs: DataFrame, cut: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of the pairs (a, b, n1, n2) whose overlaps, counted fragment by fragment and summed, reach the threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            same = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int64())], schema=arrow("a long, b long, same long"))

    side = lambda k: cut.select(F.col("cls").alias(k), "part", F.col("items").alias(f"{k}_items"))
    overlap = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "part"]).select("a", "b", "a_items", "b_items").mapInArrow(count, "a long, b long, same long")
    total = overlap.groupBy("a", "b").agg(F.sum("same").alias("same")).join(pairs, ["a", "b"])
    return total.where(F.lit(den) * F.col("same") >= F.lit(num) * (F.col("n1") + F.col("n2") - F.col("same"))).select("a", "b")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs of two components, with these as ca and cb."""
    out = pairs.drop("ca", "cb")
    for k in ("a", "b"):
        out = out.join(comp.select(F.col("cls").alias(k), F.col("component").alias(f"c{k}")), k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
    return out.where("ca <> cb")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """The pair of each component that its sketches show nearest."""
    best = pairs.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("far", "a", "b", "n1", "n2").alias("p")).groupBy("c").agg(F.min("p").alias("p"))
    return best.select("p.*").distinct()


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; linked when Jaccard >= num / den.

    Null, empty and blank texts have no shingles and stand alone. Repeated rows and equal texts get the same
    component. A null doc_id is less than all others, and so is the component_id of its group: null. Columns other
    than doc_id and text are not read.
    """
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return _placed(docs, num, den, width).select(shown("doc_id"), "n_shingles", shown("component_id"))


def _placed(docs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """near_duplicates(), with NULL_ID for null ids, and cls: the row's set (null without shingles)."""
    modest_batches(docs.sparkSession)
    docs = docs.select(safe_key(docs["doc_id"]).alias("doc_id"), "text")
    members = stored(set_digests(docs, width), "sets")
    sets = stored(members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("items").alias("items")), "classes")
    listed = prefixes(docs, frequency_classes(docs, width), num, den, width)
    lists = stored(shared_prefixes(listed, num, den), "lists")
    firsts = sets.select("cls", "doc_id")
    pairs = stored(sifted(_star(lists, num, den), sets, num, den), "pairs")
    links = stored(verified(pairs, cut_sets(pairs, docs, firsts, width), num, den), "links")
    comp = components(links).withColumnRenamed("id", "cls")
    placed = lists.join(comp, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).select("h", "cls", "n", "comp")
    rest = stored(sifted(_across(placed, sets, num, den), sets, num, den).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    cut = cut_sets(rest, docs, firsts, width)
    # A group of copies that is still in many components would have most of its pairs counted, though a few links
    # join it: each component's nearest pair comes first, and then all pairs that still lie in two components.
    for nearest in (True, True, False):
        rest = stored(_apart(rest, comp), "apart")
        if rest.isEmpty():
            break
        turn = _likeliest(rest) if nearest else rest
        links = links.union(stored(verified(turn, cut, num, den), "links"))
        comp = components(links).withColumnRenamed("id", "cls")
    least = firsts.join(comp, "cls").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = firsts.join(comp, "cls", "left").join(least, "component", "left").select("cls", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = members.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(placed, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "cls")


def without_near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs, with the rows of one document (the smallest doc_id; a null one first) of each component.

    Decided row by row: where rows of one id have different texts, each stays or goes with its own text's component,
    so that every component keeps a row. Repeated rows of an id and text that stays all stay, as do rows without
    shingles."""
    placed = stored(_placed(docs, num, den, WIDTH).withColumn("goes", F.expr("doc_id <> component_id")), "placed")
    ids = placed.groupBy("doc_id").agg(F.bool_and("goes").alias("all"), F.bool_or("goes").alias("any"))
    key = safe_key(docs["doc_id"])
    gone = ids.where("all").select(F.col("doc_id").alias("gone"))
    kept = docs.join(gone, key == gone["gone"], "left_anti")
    mixed = stored(ids.where("any and not all").select(F.col("doc_id").alias("gone")), "mixed")
    if mixed.isEmpty():
        return kept
    # ids with texts of several components: their rows are told apart by the texts' hashes
    texts = docs.join(mixed, key == mixed["gone"], "left_semi").select(F.xxhash64("text").alias("doc_id"), "text")
    sets = set_digests(texts).where("n > 0").select(F.col("doc_id").alias("h"), "cls").distinct()
    rows = placed.where("goes").join(mixed, placed["doc_id"] == mixed["gone"]).join(sets, "cls").select("gone", "h").distinct()
    return kept.join(rows, (key == rows["gone"]) & (F.xxhash64(kept["text"]) == rows["h"]), "left_anti")
