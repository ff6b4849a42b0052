"""Alignment, prefix trie and token-id files against brute force, the public libraries and awkward rows."""

import bisect
import collections
import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docketlab.llm import alignment, bpe, byte_bpe, prefix_trie, queries, simple8b, token_files

DIR = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"
DOC = "doc_id long, text string, uid string, pairs long, h string, nth int, start string, n_links int"
ODD = ["", "one", "one", " \n\t  x  ", "Ünïcode ß 漢字 \U0001f600 ﬁ　", "a<|endoftext|>b <s> </s>", "▁mark", "\x00\x01 nul", "a" * 20_000, " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000)), "the the the \r\n the"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None)] + [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "another three"), (-7, "one")]
    return spark.createDataFrame([(*r, "u", 5, None, 1, "s", 2) for r in rows], DOC)


def library(plain):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = plain
    return t


def aligned(rows):
    """The contract in loops: libraries' encodings, common ends, overlaps pair by pair."""
    a_lib, b_lib = library(True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: b for b, c in enumerate(bpe.stand_ins())}
    token = {i: bytes(byte[c] for c in t) for t, i in json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"].items()}
    piece = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    done, total = [], collections.Counter()
    for doc_id, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(map(token.get, a)) != whole or b"".join(map(piece, b)) != whole:
            done.append((doc_id, None))
            continue
        spans = []
        for ids, size in ((a, token.get), (b, piece)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(size(i))))
                at = out[-1][2]
            spans.append(out)
        starts = [s for _, s, _ in spans[1]]
        links = [(i, j) for i, s, e in spans[0] for j, x, y in spans[1][max(0, bisect.bisect_right(starts, s) - 1) : bisect.bisect_left(starts, e)] if x < e and s < y]
        total.update(links)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        form = [[[[], []] for _ in cuts], spans]
        for side in (0, 1):
            for i, _, e in spans[side]:
                form[0][bisect.bisect_left(cuts, e)][side].append(str(i))
        done.append((doc_id, (len(a), len(b), len(cuts), links, ";".join("|".join(map(",".join, g)) for g in form[0]))))
    most = collections.Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    for doc_id, x in done:
        if x is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, n_groups, links, form = x
            yield (doc_id, n_a, n_b, n_groups, len(links), sum(total[p] == most[p[1]] for p in links), sum(total[p] for p in links), hashlib.sha256(form.encode()).hexdigest())


def plain(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("common", [1 << 19, 50, 1])
def test_alignment_equals_loops(spark, odd, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    monkeypatch.setattr(alignment, "GATHERED", 3000)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert plain(alignment.align(odd).collect()) == plain(aligned(rows))


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert plain(queries.op11_alignment(spark, DIR).collect()) == plain(aligned([(r.doc_id, r.text) for r in docs.collect()]))


def test_alignment_of_nothing(odd):
    assert alignment.align(odd.limit(0)).collect() == []


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_overlaps_and_boundaries(a, b):
    short = min(sum(a), sum(b))
    cut = lambda sizes: [e for e in np.cumsum(sizes).tolist() if e < short] + [short]
    a_end, b_end = np.array(cut(a)), np.array(cut(b))
    first, last = alignment.overlaps(a_end, b_end)
    spans = lambda ends: list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    for (s, e), f, t in zip(spans(a_end), first, last, strict=True):
        assert list(range(f, t + 1)) == [j for j, (x, y) in enumerate(spans(b_end)) if x < e and s < y]
    assert b_end[alignment.closing(first, last, len(b_end))].tolist() == sorted(set(a_end.tolist()) & set(b_end.tolist()))


def test_byte_bpe_equals_the_library():
    texts = [t for t in ODD] + ["x <|endoftext|> y<|endoftext|>", "don't it's 12 345  \n\n tabs\t\t"]
    ours = byte_bpe.coder(byte_bpe.default_path())
    for encode, lib in ((ours.plain, library(True)), (ours.ids, library(False))):
        for t in texts:
            assert encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def files_of(rows):
    """doc_id, start, n_tokens, crc32 in ascending doc_id order (nulls first); rows of one id in any order."""
    lib, out, start = library(False), [], 0
    for doc_id, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    want = files_of(sorted((r.doc_id, r.text) for r in docs))
    assert sorted(map(tuple, queries.op13_token_files(spark, DIR).collect())) == want


@pytest.mark.parametrize("size", [1 << 22, 10])
def test_token_files_of_odd_rows(spark, odd, tmp_path, monkeypatch, size):
    monkeypatch.setattr(token_files, "FILE_IDS", size)
    folder = f"file://{tmp_path}/ids"
    token_files.write_ids(odd, folder)
    (tmp_path / "ids" / "lost-attempt.ids").write_bytes(b"a task that died")  # no row names it
    got = token_files.read_ids(spark, folder, with_ids=True).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    alone = lambda doc_id, text: files_of([(doc_id, text)])[0]
    assert plain((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == plain((x[0], x[2], x[3]) for x in (alone(*r) for r in rows))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    # starts follow each other without gaps, and ids ascend with them
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in order]
    assert keys == sorted(keys)
    if size == 10:
        assert token_files.files(spark, folder).count() > 4  # one for four partitions otherwise


def test_token_files_of_nothing(odd):
    assert token_files.round_trip(odd.limit(0)).collect() == []


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700), st.integers(0, 700), st.integers(0, 700))
@settings(max_examples=200, deadline=None)
def test_simple8b_round_trip(ids, start, stop):
    ids = np.array(ids, np.uint64)
    packed = simple8b.pack(ids)
    assert simple8b.unpack(packed).tolist() == ids.tolist()
    assert simple8b.unpack(packed, start, stop).tolist() == ids[start:stop].tolist()
    data = simple8b.to_bytes(np.array([5, 0]), np.array([True, False]), np.array([len(ids), 0]), ids)
    doc_id, valid, sizes, again = simple8b.from_bytes(data)
    assert (doc_id.tolist(), valid.tolist(), sizes.tolist()) == ([5, 0], [True, False], [len(ids), 0]) and simple8b.unpack(again).tolist() == ids.tolist()


def test_simple8b_is_dense_and_guarded():
    assert len(simple8b.pack(np.ones(2560, np.uint64)).words) == 10 * 5  # 60 ids a word, 256 a block
    assert len(simple8b.pack(np.full(256, 1 << 61, np.uint64)).escapes) == 256
    data = simple8b.to_bytes(np.array([1]), np.array([True]), np.array([3]), np.array([7, 8, 9], np.uint64))
    for bad in (data[:-1], data[:10], b"", data[:-1] + bytes([data[-1] ^ 1])):
        with pytest.raises(ValueError, match="token ids"):
            simple8b.from_bytes(bad)


def trie_of(rows):
    """The contract in loops over lists of turns."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, v in own.items():
        base = c - int(np.fmod(c, 20))
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(v if c == base else own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(re.findall(WORD, p[-1][1])) if p else 0)
            leaves[p[:d]] += not kids[p]
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        yield (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(None, 0, "user", "no conversation"), (0, None, None, None), (0, 0, "user", "hello there"), (0, 0, "user", "hello there"), (0, 0, "bot", "tie"), (0, 5, "user", "x  y\tz")]
    for c in (1, 2, 3, 7, 19, -3, -19, 21, 22, 45, 46, 2**62):  # 20 and 40 are absent
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c % 3}") for t in range(c % 5)]
        rows += [(c, 9, "bot", "same end for all")]
    rows += [(60, t, "user", "long") for t in range(300)] + [(61, t, "user", "long") for t in range(200)]
    rows += [(80 + i, 0, "user", "copies") for i in range(20)] + [(100 + i, 0, "user", f"children {i}") for i in range(1, 60)]
    return spark.createDataFrame([(*r, "extra", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int, base int")


@pytest.mark.parametrize(("held", "many", "piece"), [(100_000, 1000, 50_000), (7, 2, 3)])
def test_trie_equals_loops(talks, monkeypatch, held, many, piece):
    for name, value in (("HELD", held), ("MANY", many), ("PIECE", piece)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in talks.collect()]
    assert plain(prefix_trie.prefix_trie(talks).collect()) == plain(trie_of(rows))


def test_family_streams_in_pieces():
    """A family given out in pieces adds up to the same nodes."""
    rows = [(0, c, 2, bytes([k]), 1) for c in (0, 3, 5) for k in range(40)]
    whole = list(prefix_trie._family_nodes(iter(rows)))
    kept, prefix_trie.HELD = prefix_trie.HELD, 3
    try:
        pieces = list(prefix_trie._family_nodes(iter(rows)))
    finally:
        prefix_trie.HELD = kept
    total = lambda nodes: {k: (max(x[4 + 1] for x in nodes if x[1] == k), sum(x[5] for x in nodes if x[1] == k), sorted(c for x in nodes if x[1] == k for c in x[7])) for k in {x[1] for x in nodes}}
    assert len(pieces) > len(whole)
    assert {k: v[1:] for k, v in total(whole).items()} == {k: v[1:] for k, v in total(pieces).items()}


def test_trie_of_nothing(talks):
    assert prefix_trie.prefix_trie(talks.limit(0)).collect() == []
    assert prefix_trie.prefix_trie(talks.where("conv_id is null")).collect() == []
