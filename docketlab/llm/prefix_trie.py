"""Prefix trie of conversations, merged by families.

A conversation's family is its id less the remainder by FAMILY; its conversations are rebuilt from the first turns
of the family's base. A task rebuilds whole families as a stream sorted by family and conversation and builds
their small tries; only the families' combined nodes are shuffled, by the hash of their turns, for the global
trie. Sums over subtrees need no walk of the global trie: each node is owned by the family of its smallest
member, which has all of the node's ancestors; so owners get their nodes' values back, sum them up their own small
tries, and the sums of all families that share a node add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, sized, stored

FAMILY = 20
WORD = "[^\\x20\\x09-\\x0D]+"
ROOT = bytes(16)
#: Nodes of a family held at once; a family of more is given out in pieces, which add up.
HELD = 100_000
#: Children from which a node's own id is sent to them by broadcast (if counted), not by a shuffle on the node.
MANY = 1000
#: Ids in one piece of the text that is hashed for a node.
PIECE = 50_000

NODES = pa.schema([("base", pa.int64()), ("node", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("ended", pa.list_(pa.int64()))])
SUMS = pa.schema([("node", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
PIECES = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
_DDL = {"NODES": "base long, node binary, depth long, parent binary, conv_id long, n_convs long, words long, ended array<long>", "SUMS": "node binary, n_leaves long, saved_tokens long", "PIECES": "node binary, first long, ids string", "ENDS": "node binary, ends_sha256 string"}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _family_nodes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of each family's trie from rows (base, conv_id, head, turn key, words), sorted by base, the base
    conversation before the others, conversation, turn. head: how many turns of the base begin a conversation."""
    trie: dict[bytes, list] = {}
    base = conv = None
    node, depth, nth, opening = ROOT, 0, 0, []

    def visit(parent: bytes | None, words: int) -> None:
        if node in trie:
            trie[node][4] += 1
            trie[node][3] = min(trie[node][3], conv)
        else:
            trie[node] = [base, depth, parent, conv, 1, words, []]

    def step(key: bytes, words: int) -> None:
        nonlocal node, depth
        parent, depth = node, depth + 1
        node = hashlib.blake2b(parent + key, digest_size=16).digest()
        visit(parent, words)

    def given() -> Iterator[tuple]:
        for k, (b, d, p, c, n, w, e) in trie.items():
            yield b, k, d, p, c, n, w, e
        trie.clear()

    def end() -> None:
        if node not in trie:  # given out since it was visited; it adds no member
            trie[node] = [base, depth, None, conv, 0, 0, []]
        trie[node][6].append(conv)

    for b, c, head, key, words in rows:
        if c != conv:
            if conv is not None:
                end()
            if b != base:
                yield from given()
                base, opening = b, []
            conv, node, depth, nth = c, ROOT, 0, 0
            visit(None, 0)
            if c != b:
                for k, w in opening[:head]:
                    step(k, w)
        nth += 1
        if c == b and nth < 4:
            opening.append((key, words))
        if c == b or nth > head:
            step(key, words)
        if len(trie) > HELD:
            yield from given()
    if conv is not None:
        end()
    yield from given()


def _subtree_sums(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sums up each family's trie from rows (base, depth, node, parent, leaf, saved), sorted by base, deepest first,
    node. A node may have several rows: those of the family have its parent, the owner's row has its values."""
    base = depth = None
    now: dict[bytes, list] = {}
    up: dict[bytes, list] = {}

    def level() -> Iterator[tuple]:
        for node, (leaves, saved, parent) in now.items():
            if leaves or saved:
                yield node, leaves, saved
                if parent is not None:
                    at = up.setdefault(parent, [0, 0, None])
                    at[0] += leaves
                    at[1] += saved

    for b, d, node, parent, leaf, saved in rows:
        if b != base or d != depth:
            yield from level()
            now, up = (up, {}) if b == base else ({}, {})
            base, depth = b, d
        at = now.setdefault(node, [0, 0, None])
        if parent is not None:
            at[2] = parent
        at[0] += leaf
        at[1] += saved
    yield from level()


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Comma-joined ids of each node's rows (node, conv_id), sorted, PIECE at most together."""
    node, held = None, []
    for n, c in rows:
        if held and (n != node or len(held) == PIECE):
            yield node, held[0], ",".join(map(str, held))
            held = []
        node = n
        held.append(c)
    if held:
        yield node, held[0], ",".join(map(str, held))


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """SHA-256 over each node's pieces (node, first, ids), sorted; only the hash's state is held."""
    node = sha = None
    for n, _, ids in rows:
        if n != node:
            if sha:
                yield node, sha.hexdigest()
            node, sha = n, hashlib.sha256()
        else:
            sha.update(b",")
        sha.update(ids.encode())
    if sha:
        yield node, sha.hexdigest()


def _map(df: DataFrame, function, name: str) -> DataFrame:
    schema = globals()[name]
    return df.mapInArrow(lambda batches: _batched(function(_rows(batches)), schema), _DDL[name])


def family_nodes(conversations: DataFrame) -> DataFrame:
    """Combined nodes of each family's trie: base, node (a 128-bit hash of its turns), depth, parent, conv_id (the
    smallest member of the family), n_convs, words of its last turn, ended (the family's conversations that end
    there). Turns are hashed (SHA-256, 128 bits kept) and words counted before the shuffle, so texts do not move."""
    conv, role, text = F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_key = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    base = conv - conv % FAMILY
    head = F.crc32(conv.cast("string").cast("binary")) % 4
    turns = conversations.where("conv_id is not null").select(base.alias("base"), conv.alias("conv_id"), head.alias("head"), "turn", turn_key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = turns.repartition(partitions(conversations.sparkSession), "base")
    turns = turns.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "key")
    return _map(turns.select("base", "conv_id", "head", "key", "words"), _family_nodes, "NODES")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The global trie of the rebuilt conversations, one row a node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id belong to no conversation and are left out. Null roles and texts are empty; turns of one
    number (or none: these come first) are ordered by the hash of role and text, and repeated rows are turns of
    their own. A table without conversations gives no rows, not even the root. Other columns are not read. A
    conversation of any length is streamed: a task holds one family's nodes, HELD at most, not its turns.
    """
    n = partitions(conversations.sparkSession)
    families = stored(family_nodes(conversations), "trie-families")
    nodes = families.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-tree")

    owner = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = nodes.select(owner.alias("base"), "depth", "node", F.lit(None).cast("binary").alias("parent"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    have = families.select("base", "depth", "node", "parent", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    walk = own.unionByName(have).repartition(n, "base").sortWithinPartitions("base", F.desc("depth"), "node")
    sums = _map(walk, _subtree_sums, "SUMS").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ended = families.select("node", F.explode("ended").alias("conv_id"))
    pieces = _map(ended.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id"), _pieces, "PIECES")
    ends = _map(pieces.repartition(n, "node").sortWithinPartitions("node", "first"), _digests, "ENDS")

    many = sized(stored(nodes.where(F.col("n_children") >= MANY).select(F.col("node").alias("parent"), F.col("conv_id").alias("sent")), "trie-hubs"))
    few = nodes.where(F.col("n_children").between(1, MANY - 1)).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(many, "parent", "left")
    rest = told.where("sent is null and parent is not null").join(few, "parent").drop("sent")
    named = told.where("sent is not null or parent is null").withColumnRenamed("sent", "parent_conv_id").unionByName(rest)
    out = named.join(sums, "node", "left").join(ends, "node", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
