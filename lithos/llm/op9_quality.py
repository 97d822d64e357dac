"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of up to ``WORDS`` words.  Every passage is
encoded from its words and its runs of three bytes, hashed with signs into
``WORD_SLOTS`` and ``GRAM_SLOTS`` sums, and from shares of byte classes; gated
attention, learned from document labels only, weighs the passages, and the
weighted passage representation is scored.

The network is fitted on a bounded sample of labelled documents (parameters
``sample``: rows, ``most_passages``: passages of all of them together), each
with its whole text; scoring reads every passage of every whole text, some
passages at a time.  Defined cases: a null or empty text is one passage without
words and gets its score; a document with several labels counts by their mean,
one whose id has several texts by the greatest; without labels of both kinds
every score is the share of good labels (0.5 without labels); repeated rows are
scored alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_of

WORDS = 64
_MARKS = ".,;:!?|*#$%&@/<>=_-'\"()[]{}"
_CLASSES = 8 + len(_MARKS)


def _class_table() -> np.ndarray:
    """Class of each byte: other, lower, upper, digit, space, line end, beyond ASCII (two), each mark."""
    out = np.zeros(256, np.int64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[ord(" ")], out[ord("\n")] = 4, 5
    out[128:192], out[192:] = 6, 7
    for i, c in enumerate(_MARKS):
        out[ord(c)] = 8 + i
    return out


_CLASS_OF = _class_table()
WORD_SLOTS, GRAM_SLOTS = 128, 128
FEATURES = _CLASSES + 5 + WORD_SLOTS + GRAM_SLOTS
#: Passages that are encoded together; bounds the memory for a long text.
TOGETHER = 2048
#: Columns whose spread is told together; bounds the memory beside the passages.
_COLUMNS = 16


class _Slots(dict):
    """The hash of each lower-cased word: a slot and a sign."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        out = self[word] = zlib.crc32(word.lower().encode()) % (2 * WORD_SLOTS)
        return out


def passages(text: str | None) -> list[list[str]]:
    """The words of each passage of the text; one passage at least."""
    words = (text or "").split()
    return [words[i : i + WORDS] for i in range(0, len(words), WORDS)] or [[]]


def _signed(row: np.ndarray, hashed: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Sums of signs at each row's slots; a hash is twice the slot and the sign."""
    return np.bincount(row * slots + (hashed >> 1), 1.0 - 2.0 * (hashed & 1), n * slots).reshape(n, slots)


def features(chunks: list[list[str]], of: list[int], slots: _Slots | None = None) -> np.ndarray:
    """A row for each passage; ``of`` has the number of passages of its text."""
    slots, n = _Slots() if slots is None else slots, len(chunks)
    joined = [" ".join(c).encode() for c in chunks]
    sizes, counts = np.array([len(j) for j in joined]), np.array([len(c) for c in chunks])
    data = np.frombuffer(b"".join(joined), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * _CLASSES + _CLASS_OF[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :_CLASSES] = np.sqrt(kinds / np.maximum(1, sizes)[:, None])
    for i, c in enumerate(chunks):
        out[i, _CLASSES : _CLASSES + 5] = (
            len(set(c)) / len(c) if c else 1.0,
            sum(map(eq, c, c[1:])) / len(c) if c else 0.0,
            np.log1p(sizes[i] / len(c)) if c else 0.0,
            np.log1p(len(c)),
            np.log1p(of[i]),
        )
    hashed = np.fromiter((slots[w] for c in chunks for w in c), np.int64, int(counts.sum()))
    at = _CLASSES + 5
    out[:, at : at + WORD_SLOTS] = _signed(np.repeat(np.arange(n), counts), hashed, n, WORD_SLOTS) / np.sqrt(np.maximum(1, counts))[:, None]
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    three = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    inside = row[:-2] == row[2:]  # a run of three bytes is of one passage
    hashed = (three[inside] >> np.uint32(32 - (2 * GRAM_SLOTS - 1).bit_length())).astype(np.int64)
    out[:, at + WORD_SLOTS :] = _signed(row[:-2][inside], hashed, n, GRAM_SLOTS) / np.sqrt(np.maximum(1, sizes))[:, None]
    return out


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def scores(self, texts: list[str | None], slots: _Slots | None = None) -> np.ndarray:
        """The score of each text; passages of several texts are encoded together."""
        if not self.weights or not texts:
            return np.full(len(texts), self.prior)
        chunks, of, starts = [], [], []
        for text in texts:
            own = passages(text)
            starts.append(len(chunks))
            chunks += own
            of += [len(own)] * len(own)
        parts = []
        for i in range(0, len(chunks), TOGETHER):
            x = features(chunks[i : i + TOGETHER], of[i : i + TOGETHER], slots)
            parts.append(_encode(self.weights, (x - self.mean) / self.scale))
        h, a = (np.concatenate([p[k] for p in parts]) for k in ("h", "s"))
        return _pool(self.weights, h, a, np.array(starts))["p"]


def _encode(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Each passage's representation h and attention s before it is shared out."""
    made = [x[i : i + TOGETHER] @ w["e"] for i in range(0, len(x), TOGETHER)]  # single numbers become double ones, some rows at a time
    h = np.tanh(np.concatenate(made) + w["e0"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    return {"h": h, "t": t, "g": g, "s": (t * g) @ w["a"]}


def _pool(w: dict[str, np.ndarray], h: np.ndarray, s: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The attention of each passage within its bag, and the score of each bag."""
    bag = np.zeros(len(h), np.int64)
    bag[starts[1:]] = 1
    bag = np.cumsum(bag)
    a = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    a = a / np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -40, 40)))
    return {"bag": bag, "a": a, "z": z, "p": p}


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    made = _encode(w, x)
    return made | _pool(w, made["h"], made["s"], starts)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * w["c"]
    da = (h * dz[bag]).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, starts)[bag])
    dt, dg = ds[:, None] * w["a"] * g * (1 - t * t), ds[:, None] * w["a"] * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ w["v"].T + dg @ w["u"].T
    de = dh * (1 - h * h)
    out = {"c": f["z"].T @ d, "c0": d.sum(keepdims=True), "a": (t * g).T @ ds, "v": h.T @ dt, "u": h.T @ dg, "e": sum(x[i : i + TOGETHER].T @ de[i : i + TOGETHER] for i in range(0, len(x), TOGETHER)), "e0": de.sum(axis=0)}
    return {k: v + decay * w[k] for k, v in out.items()}


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, width: int = 12, gate: int = 6, rounds: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Network:
    """Adam on the log loss of the bags' labels, from a fixed start."""
    prior = float(labels.mean()) if len(labels) else 0.5
    nothing = np.zeros(FEATURES, np.float32)
    if len(set(labels.tolist())) < 2:
        return Network(nothing, nothing + 1, {}, prior)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    x = np.concatenate(bags, dtype=np.float32)
    del bags  # the driver holds the passages once from here on
    mean, scale = x.mean(axis=0), np.concatenate([x[:, i : i + _COLUMNS].std(axis=0) for i in range(0, FEATURES, _COLUMNS)]) + 0.02
    x -= mean
    x /= scale
    rng = np.random.default_rng(7)
    shapes = {"e": (FEATURES, width), "e0": (width,), "v": (width, gate), "u": (width, gate), "a": (gate,), "c": (width,), "c0": (1,)}
    w = {k: rng.normal(0, 0.5 / np.sqrt(s[0]), s).astype(np.float32) for k, s in shapes.items()}
    first = {k: np.zeros(s, np.float32) for k, s in shapes.items()}
    second = {k: np.zeros(s, np.float32) for k, s in shapes.items()}
    for step in range(1, rounds + 1):
        for k, d in _gradients(w, x, starts, labels, decay).items():
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Network(mean, scale, w, prior)


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The passages of each bag, not copied."""
    return [np.frombuffer(x.as_buffer(), "<f4").reshape(-1, FEATURES) for x in column]


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 3000, most_passages: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Learns from labelled rows where ``train`` (on the label table's id) holds.

    Labels are sampled by a hash of the id, about ``sample`` of them, so that
    only as many texts are read and joined.  The sampled rows are taken in the
    order of another hash while their passages fit ``most_passages``; a row that
    does not fit is no part of the sample, and no text is cut.
    """
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    total, good = known.agg(F.count("*"), F.coalesce(F.avg("y"), F.lit(0.5))).first()
    if not total or good in (0.0, 1.0):
        return Network(np.zeros(FEATURES), np.ones(FEATURES), {}, float(good))
    grain, order = 1 << 30, F.xxhash64(F.lit(29), "_id")
    chosen = known.where(F.pmod(F.xxhash64(F.lit(23), F.col("_id")), F.lit(grain)) < int(min(1.0, sample / total) * grain)).select("_id", "y", order.alias("at")).orderBy("at", "_id").limit(2 * sample)  # the limit bounds what is broadcast
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    texts = cut(texts.groupBy("at", "_id", "y").agg(F.max("text").alias("text")).select("at", "y", "text"), "sample")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(passages(t)) for t in batch.column(2).to_pylist()], pa.int64())], ["at", "n"])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = passages(text)
                made = [features(own[j : j + TOGETHER], [len(own)] * len(own[j : j + TOGETHER]), slots).astype("<f4").tobytes() for j in range(0, len(own), TOGETHER)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:2], pa.array([b"".join(made)], pa.binary())], ["at", "y", "bag"])

    taken, room = [], most_passages
    for row in sorted(texts.mapInArrow(sizes, "at bigint, n bigint").collect()):
        if row.n <= room:
            taken.append(row.at)
            room -= row.n
    got = texts.where(F.col("at").isin(taken)).mapInArrow(bags, "at bigint, y double, bag binary").toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("at", "ascending"), ("bag", "ascending")]))
    y, held = got["y"].to_numpy(), [got["bag"]]
    del got
    net = fit_bags(_views(held.pop()), y)  # which alone holds the passages, and lets go of them
    pa.default_memory_pool().release_unused()
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = (), whole_rows: str | None = None) -> DataFrame:
    """(id, the kept columns, score) of every row; with ``whole_rows`` all columns, and the score under that name."""
    text = F.col(text_col).cast("string").alias("_text")
    source = docs.select(F.struct("*").alias("_row"), text) if whole_rows else docs.select(F.struct(F.col(id_col), *keep).alias("_row"), text)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            if batch.num_rows:
                got = sent.value.scores(batch.column(1).to_pylist(), slots)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["_row", "_out"])

    names = source.schema["_row"].dataType.names
    made = source.mapInArrow(run, T.StructType([source.schema["_row"], T.StructField("_out", T.DoubleType())]))
    return made.select(*[F.col(f"_row.`{n}`") for n in names], F.col("_out").alias(whole_rows or "score"))
