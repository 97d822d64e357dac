import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lithos.llm import op6_jaccard as op6
from lithos.llm import op8_flac as op8

from .brute import frame, jaccard, least_reached


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=900), max_size=6))
def test_round_trip(parts):
    payloads = [p + b"\0" * (-len(p) % op8.BLOCK) for p in parts]
    streams = op8.encode_many(payloads)
    for payload, stream, pcm in zip(payloads, streams, op8.decode_many(streams)):
        assert bytes(x ^ 128 for x in pcm) == payload and op8.decode(stream) == pcm


def test_many_frames_and_seeking():
    payload = np.random.default_rng(0).integers(0, 256, op8.BLOCK * 2300, dtype=np.uint8).tobytes()
    stream = op8.encode(payload)
    meta = op8.read_meta(stream)
    assert bytes(x ^ 128 for x in op8.decode_many([stream])[0]) == payload
    want = {s: at for s, at, _ in meta["seek"]}
    at = op8._starts(np.frombuffer(stream, np.uint8), meta["first"])
    assert all(at[s // op8.BLOCK] - meta["first"] == offset for s, offset in want.items())


def test_damage_is_found():
    payload = op8.payload_of("some text that is stored " * 30)[1]
    stream = bytearray(op8.encode(payload))
    for at in (2, len(stream) - 1, len(stream) - 40, op8.read_meta(bytes(stream))["first"] + 1):
        broken = bytes(stream[:at]) + bytes([stream[at] ^ 0x55]) + bytes(stream[at + 1 :])
        with pytest.raises(op8.FlacError):
            op8.decode_many([broken])
    with pytest.raises(op8.FlacError):
        op8.decode(bytes(stream[:-3]))


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value & ((1 << n) - 1):0{n}b}" if n else ""
        return self

    def rice(self, r, k):
        z = r * 2 if r >= 0 else -r * 2 - 1
        self.bits += "0" * (z >> k) + "1"
        return self.put(z, k)

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))


def frame_of(channels, assignment, depth_code, subframes, n):
    w = Writer().put(0x3FFE, 14).put(0, 2).put(7, 4).put(0, 4).put(assignment, 4).put(depth_code, 3).put(0, 1).put(0, 8).put(n - 1, 16)
    head = w.bytes()
    w = Writer()
    w.bits = "".join(f"{b:08b}" for b in head + bytes([op8._crc(head, 8)]))
    for s in subframes:
        s(w)
    body = w.bytes()
    return body + op8._crc(body, 16).to_bytes(2, "big")


def test_any_subframe_decodes():
    """Linear prediction, escapes, partitions, wasted bits and stereo, written by hand."""
    n, rng = 16, np.random.default_rng(4)
    left, right = rng.integers(-900, 900, n).tolist(), rng.integers(-900, 900, n).tolist()
    mid, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]

    def lpc(values, depth):
        def write(w):
            w.put(0, 1).put(32 + 1, 6).put(0, 1)  # order 2
            for v in values[:2]:
                w.put(v, depth)
            w.put(5 - 1, 4).put(2, 5).put(7, 5).put(-3, 5)  # precision 5, shift 2
            w.put(0, 2).put(1, 4)  # two partitions
            res = [v - ((7 * values[i + 1] - 3 * values[i]) >> 2) for i, v in enumerate(values[2:])]
            w.put(6, 4)
            for r in res[:6]:
                w.rice(r, 6)
            w.put(15, 4).put(14, 5)  # escape: raw values of 14 bits
            for r in res[6:]:
                w.put(r, 14)

        return write

    def plain(values, depth):
        def write(w):
            w.put(0, 1).put(1, 6).put(0, 1)
            for v in values:
                w.put(v, depth)

        return write

    def wasted(values, depth):
        def write(w):
            w.put(0, 1).put(8, 6).put(1, 1).put(1, 2)  # fixed order 0, two wasted bits
            w.put(0, 2).put(0, 4).put(5, 4)
            for v in values:
                w.rice(v >> 2, 5)

        return write

    body = frame_of(2, 10, 4, [lpc(mid, 16), plain(side, 17)], n)
    fours = [v & ~3 for v in right]
    body2 = frame_of(2, 8, 4, [plain(left, 16), plain([a - b for a, b in zip(left, right)], 17)], n)
    body3 = frame_of(2, 1, 4, [wasted(fours, 16), lambda w: w.put(0, 8).put(-5, 16)], n)
    pcm = b"".join(int(v).to_bytes(2, "little", signed=True) for a, b in ((left, right), (left, right), (fours, [-5] * n)) for pair in zip(a, b) for v in pair)
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | 3 * n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    stream = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + body + body2 + body3
    assert op8.decode(stream) == pcm == op8.decode_many([stream])[0]


PROSE = "Some quiet words about the sea, and of what it leaves on the sand each evening. " * 40


def test_linear_frames_are_written_and_decoded(monkeypatch):
    """Frames of linear prediction, of noise and of ramps: the fast reader and the bit-by-bit one agree with the payload."""
    ramp = bytes((i * 3) % 256 for i in range(op8.BLOCK * 5))
    payloads = [op8.payload_of(PROSE)[1], ramp, bytes(op8.BLOCK), bytes([255] * op8.BLOCK), np.random.default_rng(3).integers(0, 256, op8.BLOCK * 40, dtype=np.uint8).tobytes()]
    streams = op8.encode_many(payloads)
    kinds = Counter()
    for stream in streams:
        for i, at in enumerate(op8._starts(np.frombuffer(stream, np.uint8), op8.read_meta(stream)["first"])):
            kinds[stream[at + len(op8._headers(i + 1)[i])] >> 1] += 1
    assert kinds[31 + op8.LPC] > 10 and sum(n for k, n in kinds.items() if 8 <= k <= 12) > 5
    slow = [op8.decode(s) for s in streams]
    monkeypatch.setattr(op8, "decode", None)  # the fast reader needs no help
    assert op8.decode_many(streams) == slow and [bytes(x ^ 128 for x in p) for p in slow] == payloads


def test_seek_point_reads_only_what_follows():
    stream = op8.encode(op8.payload_of(PROSE)[1])
    pcm, meta = op8.decode(stream), op8.read_meta(stream)
    assert [p[0] for p in meta["seek"]] == list(range(0, len(pcm), op8.BLOCK * op8.SEEK_EVERY)) and len(meta["seek"]) > 1
    broken = bytearray(stream)
    broken[meta["first"] + 9] ^= 0xFF  # a frame before the seek point
    at = op8.BLOCK * op8.SEEK_EVERY + 5
    assert op8.read_at(bytes(broken), at, 300) == pcm[at : at + 300] and op8.read_at(stream, 0, 10**9) == pcm
    with pytest.raises(op8.FlacError):
        op8.read_at(bytes(broken), 0, 10)


@pytest.mark.parametrize("text_ids", [False, True])
def test_columns(spark, text_ids):
    texts = [None, "", "a", "é" * 100, "x" * 60_000, "a", PROSE]
    docs = frame(spark, list(enumerate(texts)) + [(None, "b")]).selectExpr("*", "1 AS media", "2 AS blocks", "3 AS n_bytes")
    if text_ids:
        docs = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    key = (lambda i: f"d{i}") if text_ids else (lambda i: i)
    stored = op8.text_media(docs).collect()
    media = {r.doc_id: r.media for r in stored}
    assert len(stored) == 8 and media[key(0)] == media[key(1)] and media[key(2)] == media[key(5)]
    by = {key(i): t for i, t in enumerate(texts)} | {None: "b"}
    for row in op8.media_digests(docs).collect():
        n, payload = op8.payload_of(by[row.doc_id])
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        form, signed = op8.encode(payload), [b - 128 for b in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(signed, signed[1:]))
        assert (row.media_bytes, row.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        assert row.feature == f"frames={len(payload) // 192};min={min(signed)};max={max(signed)};sum={sum(signed)};energy={sum(v * v for v in signed)};turns={turns}"
    table = op8.text_media(docs)
    blocks = op8.pcm_blocks(table, "doc_id").where(F.col("doc_id") == key(4)).orderBy("sample_offset").collect()
    pcm = op8.decode(media[key(4)])
    step = op8.BLOCK * op8.SEEK_EVERY
    assert b"".join(b.pcm for b in blocks) == pcm and [b.sample_offset for b in blocks] == list(range(0, len(pcm), step)) and all(b.samples == len(b.pcm) for b in blocks)
    binary = docs.selectExpr("doc_id", f"unhex(if(doc_id = '{key(0)}', null, repeat('41', 192))) AS payload")
    back = op8.decode_column(op8.encode_column(binary, "payload")).collect()
    assert all((r.pcm is None) == (r.payload is None) for r in back)
    assert op8.pcm_blocks(op8.encode_column(docs.selectExpr("doc_id", "unhex('') AS payload"), "payload"), "doc_id").count() == 0
    assert op8.media_digests(frame(spark, [])).count() == 0


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[int(rng.integers(0, len(words)))] = f"w{rng.integers(0, 10**9)}"
    return words


def corpus(rng, families=10, copies=8):
    rows = []
    for f in range(families):
        base = [f"v{x}" for x in rng.integers(0, 400, int(rng.integers(3, 120)))]
        for _ in range(copies):
            rows.append(" ".join(near(rng, base, int(rng.integers(0, 4)))))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_join_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(op6, "SMALL", 4)
    monkeypatch.setattr(op6, "LEAF_ROWS", 8)
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = corpus(rng) + corpus(rng, 1, 60) + [passage + " " + " ".join(f"z{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(5, 30)))) for _ in range(40)]
    texts += [None, "", " \n ", "A b c", "a B\tc", "a b", "é É", "same text here and there again"] + ["same text here and there again"] * 5
    rows = list(enumerate(texts))
    docs = frame(spark, rows).selectExpr("*", "1 AS n", "2 AS digest")
    got = {r.id: (r.n_shingles, r.component_id) for r in op6.Join(docs).components().collect()}
    assert got == jaccard(rows)


def test_join_long_blocks_across_partitions(spark, monkeypatch):
    """One family that fills blocks over many batches and partitions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join(near(rng, base, int(rng.integers(0, 3))))) for i in range(300)]
    try:
        got = {r.id: (r.n_shingles, r.component_id) for r in op6.Join(frame(spark, rows)).components().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == jaccard(rows)


def test_join_odd_tables(spark):
    assert op6.Join(frame(spark, [])).components().count() == 0
    docs = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "q " * 30_000)])
    got = sorted((r.id or 0, r.n_shingles, r.component_id) for r in op6.Join(docs).components().collect() if r.n_shingles)
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (3, 1, 3)]
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumn("id", F.lit(1)).withColumn("points", F.lit(2))
    got = sorted((r.id or "", r.n_shingles, r.component_id) for r in op6.Join(named).components().collect() if r.n_shingles)
    assert got == [("", 2, "d1"), ("d1", 2, "d1"), ("d1", 2, "d1"), ("d3", 1, "d3")]


def test_tree_links_what_blocks_leave(spark, monkeypatch):
    """Families that share one rare passage: they stand in one large block whose centre is near none of them."""
    monkeypatch.setattr(op6, "SMALL", 4)
    told = []
    left = op6._left
    monkeypatch.setattr(op6, "_left", lambda *a: told.append(left(*a)) or told[-1])
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rare = [f"rare{i}" for i in range(7)]
    rows = []
    for _ in range(8):
        base = words(60)
        rows += [" ".join(base + rare), " ".join(base[:57] + words(1) + base[58:] + rare)]
    rows = list(enumerate(rows))
    got = {r.id: (r.n_shingles, r.component_id) for r in op6.Join(frame(spark, rows)).components().collect()}
    assert got == jaccard(rows) and len({c for _, c in got.values()}) == 8 and told


def test_tree_search_is_complete():
    rng = np.random.default_rng(0)
    points = rng.poisson(4, (700, op6.GROUPS))
    points[350:] = np.maximum(0, points[:350] + rng.integers(-1, 2, (350, op6.GROUPS)))
    tree = op6.Tree(points, fan=8)
    assert [len(x) for x in tree.children] == [88, 11, 2, 1] and sorted(np.concatenate(tree.children[0]).tolist()) == list(range(700))
    for q in points[:60]:
        want = np.flatnonzero(180 * np.minimum(points, q).sum(axis=1) >= 80 * (q.sum() + points.sum(axis=1)))
        assert set(want) == set(tree.search(q, 80))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1060)]
    nodes = {x for e in edges for x in e}
    got = {r.node: r.root for r in op6.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least_reached(nodes, edges)
