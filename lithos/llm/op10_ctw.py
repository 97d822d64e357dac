"""Language-model scores by context-tree weighting.

Bytes are split into eight binary decisions.  For every decision the contexts
are the 0 to ``DEPTH`` bytes before; Krichevsky-Trofimov estimates of all
depths are mixed by context-tree weighting.  Every window of ``DEPTH`` + 1
bytes of the training corpus is counted in one distributed table, which grows
with the corpus; the counts of shorter contexts are its sums.  A text's
probability includes its end, marked by byte 0xFF, which UTF-8 never uses; the
same byte stands before the start.

Every context counts for itself, however many there are.  Contexts that end in
the same two bytes stand in one task, which weighs their subtrees; what is above
(65,792 contexts at most) is weighed from their sums.  The probabilities of the
``hot`` most frequent windows are looked up in the workers; those of all other
windows of a text, windows that training never met among them, come by a join.
A bit that a context has not met is told by the longest one that has.  With
``contexts`` given, a tree of as many contexts scores instead, in one process
and for estimates only: the contexts that a node does not keep are one child of
it there, with the sum of their counts.  The base score is a smoothed word
unigram: the ``head`` most frequent words are looked up in the workers, all
others by a join.

Defined cases: null text is empty (one end token); an empty training set gives
even odds; rows that agree in id and text get the same scores; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

END = 0xFF
DEPTH, STEP = 5, 2000
#: Contexts of a merged tree; None: all contexts, each for itself.
CONTEXTS = None
#: Words and windows that the workers look up; the others are joined.
HEAD, HOT = 1 << 17, 1 << 20
#: Codes and words that a worker gathers before it hands them on.
FLUSH_CODES, FLUSH_WORDS = 1 << 22, 1 << 18
_LOG2, _LOG10_2 = math.log(2), math.log10(2)
#: Contexts handled together when the tree is weighed.
_CHUNK = 2048
#: Rows of a batch of windows that a task hands on.
_WIDE = 1 << 16
#: Bytes of a packed tree in one row.
_PIECE = 1 << 22


def codes_of(data: bytes, depth: int = DEPTH, end: bool = True) -> np.ndarray:
    """The ``depth`` bytes before each byte, and the byte, as one number; the last byte is lowest."""
    b = np.frombuffer(data + b"\xff" if end else data, np.uint8).astype(np.int64)
    out = b[depth:].copy()
    for i in range(depth):
        out |= b[i : len(b) - depth + i] << (8 * (depth - i))
    return out


def windows(text: str | None, depth: int = DEPTH, most: int = FLUSH_CODES) -> Iterator[np.ndarray]:
    """The codes of a text and of its end, a long text in parts: each code once."""
    data = b"\xff" * depth + (text or "").encode() + b"\xff"
    for i in range(0, len(data) - depth, most):
        yield codes_of(data[i : i + most + depth], depth, end=False)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: shifted by eight, then Stirling's series."""
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 inner nodes of the byte tree, level by level, for rows of 256 counts."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, -1).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _estimates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each inner node of rows of counts: log KT probability, odds of a one, whether it was met."""
    zeros, ones = _nodes(counts.astype(np.float64))
    met = zeros + ones > 0
    log = np.zeros(zeros.shape)
    log[met] = _log_kt(zeros[met], ones[met])
    return log, (ones + 0.5) / (zeros + ones + 1), met


def _by_byte(one_odds: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the nodes' probabilities of a one."""
    out = np.zeros((len(one_odds), 256))
    value = np.arange(256)
    for level in range(8):
        p = one_odds[:, (1 << level) - 1 + (value >> (8 - level))]
        out += np.log10(np.where(value >> (7 - level) & 1, p, 1 - p))
    return out


class Tree(NamedTuple):
    """Each kept context's children by the byte before, and its probabilities of the next byte.

    ``first`` is the longest kept context of two bytes at most, by those bytes;
    ``inner`` is a context's row in ``child`` or -1; ``child`` gives the row of
    the context that is one byte longer, or 0; ``table`` holds -log10 in steps.
    """

    depth: int
    first: np.ndarray
    inner: np.ndarray
    child: np.ndarray
    table: np.ndarray

    def rows(self, code: np.ndarray) -> np.ndarray:
        """The longest kept context of each code."""
        row = self.first[code >> 8 & 0xFFFF].astype(np.int32)
        at, place = np.arange(len(code), dtype=np.int32), row
        for d in range(3, self.depth + 1):
            inner = self.inner[place]
            on = np.flatnonzero(inner >= 0).astype(np.int32)  # a context that is shorter than d - 1 has no row here
            at, inner = at[on], inner[on]
            place = self.child[inner, code[at] >> (8 * d) & 255]
            on = np.flatnonzero(place)  # the root is no one's child
            at, place = at[on], place[on]
            row[at] = place
        return row

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None], most: int = 1 << 20) -> list[float]:
        """log10 probability of each text and its end; short texts are looked up together."""
        out = np.zeros(len(texts), np.int64)
        for of, starts, code in _together(texts, self.depth, most):
            np.add.at(out, of, np.add.reduceat(self.table[self.rows(code), code & 255].astype(np.int64), starts))
        return (-out / STEP).tolist()


def _together(texts: list[str | None], depth: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, where it starts, codes) of several texts at once, of about ``most`` codes."""
    some, size = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(c) for _, c in some[:-1])])
        return np.array([i for i, _ in some]), starts, np.concatenate([c for _, c in some])

    for i, text in enumerate(texts):
        for code in windows(text, depth, most):
            if some and size + len(code) > most:
                yield joined()
                some, size = [], 0
            some.append((i, code))
            size += len(code)
    if some:
        yield joined()


class Known:
    """The log10 probabilities of some windows, found by their codes; ``top`` has what the two shortest depths tell.

    Codes that share a slot of a table go on to the next, smaller one.
    """

    def __init__(self, depth: int, code: np.ndarray, value: np.ndarray, top: np.ndarray):
        self.depth, self.code, self.value, self.top = depth, code, value, top
        self._tables: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}  # each worker makes its own

    def tables(self) -> list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]]:
        if self._tables is None:
            made, code, value, factor = [], self.code, self.value, 0x9E3779B97F4A7C15
            while len(code):
                shift = np.uint64(64 - max(4, len(code).bit_length()))
                slot = code.view(np.uint64) * np.uint64(factor) >> shift
                keys, values = np.full(1 << 64 - int(shift), -1, np.int64), np.zeros(1 << 64 - int(shift))
                keys[slot], values[slot] = code, value  # the last of a slot stays
                made.append((np.uint64(factor), shift, keys, values))
                left = keys[slot] != code
                code, value, factor = code[left], value[left], factor * 0xD1342543DE82EF95 % 2**64 | 1
            self._tables = made
        return self._tables

    def look(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code, 0 for those that are not here; and the places of these."""
        out, at = np.zeros(len(code)), None
        for factor, shift, keys, values in self.tables():
            here = code if at is None else code[at]
            slot = here.view(np.uint64) * factor >> shift
            got = keys[slot] == here
            if at is None:
                out = values[slot]
                out[~got] = 0
                at = np.flatnonzero(~got)
            else:
                out[at[got]] = values[slot[got]]
                at = at[~got]
            if not len(at):
                break
        return out, np.arange(len(code)) if at is None else at

    def sums(self, texts: list[str | None], most: int = 1 << 20) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The known windows' part of each text's log10 probability; (text, code, how often) of the others."""
        out, rest = np.zeros(len(texts)), []
        for of, starts, code in _together(texts, self.depth, most):
            value, gone = self.look(code)
            np.add.at(out, of, np.add.reduceat(value, starts))
            if len(gone):
                owner, code = of[np.searchsorted(starts, gone, "right") - 1], code[gone]
                order = np.lexsort([code, owner])
                owner, code = owner[order], code[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]))
                rest.append((owner[first], code[first], np.diff(first, append=len(code))))
        return out, rest

    def scores(self, texts: list[str | None], most: int = 1 << 20) -> list[float]:
        """The known windows' part of each text's log10 probability."""
        return self.sums(texts, most)[0].tolist()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


_FEW = 1 << 12
_AT_HALF: list[np.ndarray] = []


def _log_kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """As :func:`_log_kt`, for whole counts; those under ``_FEW`` from tables."""
    if not _AT_HALF:
        _AT_HALF.extend((_lgamma(np.arange(_FEW) + 0.5), _lgamma(np.arange(_FEW) + 1.0)))

    def of(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
        out = table[np.minimum(n, _FEW - 1)]
        big = np.flatnonzero(n >= _FEW)
        out[big] = _lgamma(n[big] + more)
        return out

    half, one = _AT_HALF
    return of(zeros, half, 0.5) + of(ones, half, 0.5) - of(zeros + ones, one, 1.0) - math.log(math.pi)


class _Forest:
    """The contexts of two bytes and more over some windows, all that share their last two bytes among them.

    ``keys[d]`` are the distinct (context of d bytes, last byte first; next byte)
    in order, ``counts[d]`` how often training met them, ``up[d]`` the place of
    the one that is a byte shorter.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int):
        key = np.zeros(len(code), np.int64)
        for i in range(1, depth + 1):
            key = key << 8 | code >> 8 * i & 255
        self.depth = depth
        key, self.first, self.place = np.unique(key << 8 | code & 255, return_index=True, return_inverse=True)
        self.keys, self.up = {depth: key}, {}
        self.counts = {depth: np.bincount(self.place, n, len(key)).astype(np.int64)}
        for d in range(depth - 1, 1, -1):
            longer = self.keys[d + 1]
            self.keys[d], self.up[d + 1] = np.unique(longer >> 16 << 8 | longer & 255, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.keys[d])).astype(np.int64)

    def bit(self, level: int) -> tuple[dict, dict, dict, dict, dict]:
        """Of the nodes of a bit, by depth: the node of each key, a key of each node, (met, odds of a one), log weighted probability, weight of the own estimate."""
        node, start, told, weighted, own = {}, {}, {}, {}, {}
        for d in range(self.depth, 1, -1):
            key = self.keys[d]
            prefix = key >> 8 - level
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            start[d], node[d] = np.flatnonzero(new), np.cumsum(new) - 1
            total = np.add.reduceat(self.counts[d], start[d])
            ones = np.add.reduceat(np.where(key >> 7 - level & 1, self.counts[d], 0), start[d])
            told[d] = total > 0, (ones + 0.5) / (total + 1)
            log = _log_kt_of(total - ones, ones)
            if d == self.depth:
                weighted[d], own[d] = log, np.ones(len(log))
                continue
            parent = node[d][self.up[d + 1][start[d + 1]]]
            weighted[d] = np.logaddexp(log, np.bincount(parent, weighted[d + 1], len(log))) - _LOG2
            own[d] = np.exp(log - weighted[d] - _LOG2)
        return node, start, told, weighted, own

    def below(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(last byte * 256 + node, log weighted probability) of each context of two bytes."""
        _, start, _, weighted, _ = self.bit(level)
        return self._place(start, level), weighted[2]

    def _place(self, start: dict, level: int) -> np.ndarray:
        key = self.keys[2][start[2]]
        return (key >> 16) * 256 + (1 << level) + ((key & 255) >> 8 - level)

    def log10(self, top: np.ndarray) -> np.ndarray:
        """The log10 probability of each window; ``top`` is that of :func:`_top`."""
        out = np.zeros(len(self.keys[self.depth]))
        for level in range(8):
            node, start, told, _, own = self.bit(level)
            sure, free, odds = top[:, self._place(start, level)]
            for d in range(2, self.depth + 1):
                if d > 2:
                    parent = node[d - 1][self.up[d][start[d]]]
                    sure, free, odds = sure[parent], free[parent], odds[parent]
                met, p = told[d]
                sure = np.where(met, sure + free * own[d] * p, sure)
                free = np.where(met, free * (1 - own[d]), free)
                odds = np.where(met, p, odds)
            one = (sure + free * odds)[node[self.depth]]
            out += np.log10(np.where(self.keys[self.depth] >> 7 - level & 1, one, 1 - one))
        return out


def _top(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """What contexts of no and of one byte tell of a one: sure share, weight left, odds of the longest that met the node.

    ``counts`` are by (byte before, byte), ``below`` by (byte before, node): the
    logs of the weighted probabilities of the contexts of two bytes.  The result
    is three rows over byte before * 256 + node.
    """
    sure, free, odds = np.zeros((256, 255)), np.ones((256, 255)), np.full((256, 255), 0.5)
    log, p, met = _estimates(counts)
    weighted = np.where(met, np.logaddexp(log, below[:, 1:]) - _LOG2, 0)
    log0, p0, met0 = _estimates(counts.sum(axis=0, keepdims=True))
    weighted0 = np.logaddexp(log0, weighted.sum(axis=0, keepdims=True)) - _LOG2
    for m, lo, w, q in ((met0, log0, weighted0, p0), (met, log, weighted, p)):
        own = np.where(m, np.exp(np.where(m, lo - w, 0) - _LOG2), 0)
        sure, free, odds = sure + free * own * q, free * (1 - own), np.where(m, q, odds)
    out = np.zeros((3, 256, 256))
    out[:, :, 1:] = sure, free, odds
    return out.reshape(3, -1)


def _forests(rows: DataFrame, depth: int, made: Callable[[_Forest, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``made`` of the windows of each task; ``rows`` start with (code, n) and are dealt by the last two bytes of their contexts."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(some, some[0].schema) if (some := [b for b in batches if b.num_rows]) else None
        if table is not None:
            yield from made(_Forest(table["code"].to_numpy(), table["n"].to_numpy(), depth), table)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data, much work: not merged
    dealt = rows.repartition(n, F.expr("shiftright(code, 8) & 65535")).select(*names)
    return dealt.mapInArrow(run, schema)


def _weighed(codes: DataFrame, depth: int) -> np.ndarray:
    """:func:`_top` of all windows; 131,072 sums at most reach the driver."""

    def made(forest: _Forest, table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = forest.keys[2]
        sums = np.zeros((2, 1 << 16))
        sums[0] = np.bincount((key >> 16) * 256 + (key & 255), forest.counts[2], 1 << 16)
        for level in range(8):
            sums[1] += np.bincount(*forest.below(level), 1 << 16)
        kind, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(sums[kind, at])], ["kind", "at", "x"])

    got = _forests(codes.select("code", "n"), depth, made, "kind bigint, at bigint, x double").groupBy("kind", "at").agg(F.sum("x").alias("x")).toArrow()
    sums = np.zeros((2, 1 << 16))
    sums[got["kind"].to_numpy(), got["at"].to_numpy()] = got["x"].to_numpy()
    return _top(*sums.reshape(2, 256, 256))


def _log10_of(codes: DataFrame, depth: int, top: np.ndarray) -> DataFrame:
    """(code, p): the log10 probability of each window of (code, n, want) that is wanted; a code's counts are added up."""
    sent = codes.sparkSession.sparkContext.broadcast(top)  # 1.5 MB

    def made(forest: _Forest, table: pa.Table) -> Iterator[pa.RecordBatch]:
        p, want = forest.log10(sent.value), np.zeros(len(forest.first), bool)
        want[forest.place[table["want"].to_numpy()]] = True
        code, p = table["code"].to_numpy()[forest.first[want]], p[want]
        for i in range(0, len(code), _WIDE):
            yield pa.RecordBatch.from_arrays([pa.array(code[i : i + _WIDE]), pa.array(p[i : i + _WIDE])], ["code", "p"])

    return _forests(codes.select("code", "n", "want"), depth, made, "code bigint, p double")


def build(levels: list[tuple[np.ndarray, np.ndarray]], depth: int) -> Tree:
    """The weighted mixture of all depths.

    ``levels[d]`` has the codes (context of d bytes, next byte) of the kept
    contexts of depth d, and their counts; a kept context's shorter ones are kept.
    """
    contexts, counts = [], []
    for d, (code, count) in enumerate(levels):
        here, where = np.unique(code >> 8, return_inverse=True)
        if not d and not len(here):
            here = np.zeros(1, np.int64)
        table = np.zeros((len(here), 256), np.float32)
        np.add.at(table, (where, code & 255), count)
        contexts.append(here)
        counts.append(table)
    first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    parent = [np.zeros(0, np.int64)] + [np.searchsorted(contexts[d - 1], contexts[d] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, len(levels))]
    # upwards: each node's weighted probability, and the weight of its own estimate
    below, rest, keep = np.zeros((0, 255)), [], []
    for d in range(len(levels) - 1, -1, -1):
        left, deeper = counts[d].copy(), np.zeros((len(contexts[d]), 255))
        has = np.zeros(len(contexts[d]), bool)
        if d + 1 < len(levels):
            np.subtract.at(left, parent[d + 1], counts[d + 1])
            np.add.at(deeper, parent[d + 1], below)
            has[parent[d + 1]] = True
        weighted, own = np.empty_like(deeper), np.empty((len(has), 255), np.float32)
        for i in range(0, len(has), _CHUNK):
            part = slice(i, i + _CHUNK)
            log, _, _ = _estimates(counts[d][part])
            split = np.logaddexp(log, deeper[part] + _estimates(np.maximum(left[part], 0))[0]) - _LOG2
            weighted[part] = np.where(has[part, None], split, log)
            own[part] = np.where(has[part, None], np.exp(log - weighted[part] - _LOG2), 1)
        below = weighted
        rest.insert(0, np.maximum(left, 0))
        keep.insert(0, own)
    # downwards: what the shorter contexts tell, and the weight that is left for longer ones
    table = np.empty((first[-1], 256), np.uint16)
    told, open_, odds = np.zeros((1, 255), np.float32), np.ones((1, 255), np.float32), np.full((1, 255), 0.5, np.float32)
    for d in range(len(levels)):
        at = parent[d] if d else np.zeros(len(contexts[0]), np.int64)
        n = len(contexts[d])
        now = [np.empty((n, 255), np.float32) for _ in range(3)]
        for i in range(0, n, _CHUNK):
            part = slice(i, i + _CHUNK)
            up = at[part]
            _, p, met = _estimates(counts[d][part])
            p = np.where(met, p, odds[up])
            sure = told[up] + open_[up] * keep[d][part] * p
            free = open_[up] * (1 - keep[d][part])
            _, q, met = _estimates(rest[d][part])
            table[first[d] + i : first[d] + min(n, i + _CHUNK)] = np.minimum(np.rint(-STEP * _by_byte(sure + free * np.where(met, q, p))), 0xFFFF)
            now[0][part], now[1][part], now[2][part] = sure, free, p
        told, open_, odds = now
    inner = np.full(first[-1], -1, np.int32)
    has = np.unique(np.concatenate([np.zeros(0, np.int64), *(first[d - 1] + parent[d] for d in range(1, len(levels)))]))
    inner[has] = np.arange(len(has))
    child = np.zeros((max(1, len(has)), 256), np.uint16)
    for d in range(1, len(levels)):
        child[inner[first[d - 1] + parent[d]], contexts[d] >> 8 * (d - 1) & 255] = first[d] + np.arange(len(contexts[d]))
    shallow = np.zeros(1 << 16, np.uint16)
    for d in range(1, min(2, len(levels) - 1) + 1):
        many = np.arange(1 << 16 - 8 * d) << 8 * d
        shallow[(contexts[d][:, None] | many).reshape(-1)] = np.repeat(first[d] + np.arange(len(contexts[d])), len(many))
    inner[: first[min(2, len(levels) - 1)]] = -1  # those of fewer than two bytes are told by the shallow table
    return Tree(depth, shallow, inner, child, table)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and b'' for the end."""
    return [*(text or "").encode().lower().split(), b""]


def _count(texts: DataFrame, depth: int) -> DataFrame:
    """(word, code, n): counts of words (code null) and of byte codes (word null) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes: list[np.ndarray] = []
        size = 0

        def some(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size
            if codes and (final or size > FLUSH_CODES):
                every = np.concatenate(codes)
                codes.clear()
                size = 0
                every.sort()
                at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.array(every[at]), pa.array(np.diff(at, append=len(every)))], ["word", "code", "n"])
            if words and (final or len(words) > FLUSH_WORDS):
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "code", "n"])
                words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(tokens(text))
                for part in windows(text, depth):
                    codes.append(part)
                    size += len(part)
                    yield from some(False)
        yield from some(True)

    return texts.mapInArrow(run, "word binary, code bigint, n bigint").groupBy("word", "code").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    tree: Tree | Known
    words: DataFrame  # (word, n)
    head: dict[bytes, int]
    train_tokens: int
    train_words: int
    codes: DataFrame  # (code, n)

    def log10(self, n: int) -> float:
        return math.log10((n + 0.1) / (self.train_tokens + 0.1 * (self.train_words + 1)))


def _least(counted: DataFrame, most: int) -> Column:
    """Whether a row is of the greatest ``n``, ``most`` at most: those above a count that a histogram of counts gives.

    Counts are kept to their ten leading bits there, so it has few rows, and no
    task merges the candidates of all others.
    """
    shift = F.greatest(F.floor(F.log2("n")).cast("int") - 9, F.lit(0))
    step = counted.select(shift.alias("s"), "n").select(F.expr("shiftleft(shiftright(n, s), s)").alias("least")).groupBy("least").count()
    least, total = None, 0
    for row in sorted(step.collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["least"]
    return F.lit(False) if least is None else F.col("n") >= least


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the greatest ``n``, ``most`` at most."""
    return counted.where(_least(counted, most))


def _tree(codes: DataFrame, depth: int, contexts: int) -> Tree:
    """The tree of the most frequent contexts, from the (code, n) of the deepest ones.

    One threshold serves all depths, so that a kept context's shorter ones are kept.
    """
    levels = {depth: codes}
    for d in range(depth - 1, -1, -1):
        low = F.col("code").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("code")
        levels[d] = cut(levels[d + 1].groupBy(low).agg(F.sum("n").alias("n")), "ctw")
    total, every = None, None
    for d, level in levels.items():
        each = level.groupBy(F.lit(d).alias("d"), F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("n"))
        total = each if total is None else total.unionByName(each)
        level = level.select(F.lit(d).alias("d"), F.shiftright("code", 8).alias("context"), "code", "n")
        every = level if every is None else every.unionByName(level)
    kept = _frequent(cut(total, "contexts"), contexts).select("d", "context")
    found = every.join(F.broadcast(kept), ["d", "context"], "left_semi").select("d", "code", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [[c.to_numpy() for c in batch.columns] for batch in batches]
        d, code, n = (np.concatenate([x[i] for x in some] + [np.zeros(0, np.int64)]) for i in range(3))
        tree = build([(code[d == i], n[d == i]) for i in range(depth + 1)], depth)
        for name in Tree._fields[1:]:
            data = getattr(tree, name).tobytes()
            for i in range(0, len(data), _PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i]), pa.array([data[i : i + _PIECE]], pa.binary())], ["name", "i", "data"])

    # one task: ``contexts`` times 256 rows at most, far fewer in fact
    packed = found.repartition(1).mapInArrow(run, "name string, i bigint, data binary").toArrow().sort_by("i")
    if not packed.num_rows:  # nothing was counted
        return build([(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (depth + 1), depth)
    part = {}
    for name, kind, wide in (("first", np.uint16, 0), ("inner", np.int32, 0), ("child", np.uint16, 256), ("table", np.uint16, 256)):
        data = b"".join(x.as_py() for x, of in zip(packed["data"], packed["name"], strict=True) if of.as_py() == name)
        part[name] = np.frombuffer(data, kind).reshape(-1, wide) if wide else np.frombuffer(data, kind)
    return Tree(depth, **part)


def _known(codes: DataFrame, depth: int, hot: int) -> Known:
    top = _weighed(codes, depth)
    got = _log10_of(codes.select("code", "n", _least(codes, hot).alias("want")), depth, top).toArrow().combine_chunks()
    return Known(depth, got["code"].to_numpy(), got["p"].to_numpy(), top)


def fit(texts: DataFrame, head: int = HEAD, depth: int = DEPTH, contexts: int | None = CONTEXTS, hot: int = HOT) -> Model:
    """Learns from all rows of the one text column of ``texts``; ``depth`` is 2 to 6.

    ``contexts``, below 2**16, asks for a merged tree of as many contexts.
    ``head`` and ``hot`` only say which words and windows are joined.
    """
    counts = cut(_count(texts, depth), "ctw")
    words, codes = counts.where("word IS NOT NULL").select("word", "n"), counts.where("code IS NOT NULL").select("code", "n")
    tree = _known(codes, depth, hot) if contexts is None else _tree(codes, depth, contexts)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = _frequent(words, head).toArrow()
    return Model(tree, words, dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)), total, distinct, codes)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id, the kept columns, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``bits_per_byte`` is the code length of the text and its end by the bytes of
    both.  Texts are read once: their words and windows that are not looked up
    are written beside what is, each under a number of its row.
    """
    context = docs.sparkSession.sparkContext
    tree = context.broadcast(model.tree)  # 45 MB at most
    head = context.broadcast({w: (n, model.log10(n)) for w, n in model.head.items()})
    rows = docs.select(F.col(id_col), *keep, F.monotonically_increasing_id().alias("_row"), text_of(text_col).alias("_text"))
    kept = rows.columns[:-1]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    own = {"n_tokens": pa.int64(), "_head": pa.int64(), "_base": pa.float64(), "_score": pa.float64(), "_size": pa.int64()}
    tail = {"word": pa.binary(), "code": pa.int64(), "tf": pa.int64()}
    names = [*kept, *own, *tail]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model_ = head.value, tree.value
        for batch in batches:
            texts, out, at, words, counts = batch.column(len(kept)).to_pylist(), [], [], [], []
            sums, others = model_.sums(texts) if isinstance(model_, Known) else (model_.scores(texts), [])
            for i, (t, p) in enumerate(zip(texts, sums, strict=True)):
                n, here, base = Counter(tokens(t)), 0, []
                for w, c in n.items():
                    if (got := known.get(w)) is None:
                        at.append(i)
                        words.append(w)
                        counts.append(c)
                    else:
                        here += c
                        base.append(c * got[1])
                out.append((n.total(), here, math.fsum(base), p, len(t.encode()) + 1))
            cols = list(zip(*out, strict=True)) or [[]] * len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, own.values(), strict=True)), *(pa.nulls(len(out), k) for k in tail.values())], names)
            for where, word, code, tf in [(at, words, None, counts), *((i, None, c, n) for i, c, n in others)]:
                size = len(tf)
                row = batch.column(len(kept) - 1).take(pa.array(where, pa.int64()))
                part = [pa.nulls(size, pa.binary()) if word is None else pa.array(word, pa.binary()), pa.nulls(size, pa.int64()) if code is None else pa.array(code), pa.array(tf, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(size, c.type) for c in batch.columns[:-2]), row, *(pa.nulls(size, k) for k in own.values()), *part], names)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "n_tokens bigint, _head bigint, _base double, _score double, _size bigint, word binary, code bigint, tf bigint"])
    made = cut(rows.mapInArrow(run, schema), "scored")
    size = F.lit(model.train_tokens + 0.1 * (model.train_words + 1))
    seen, nothing = F.coalesce(F.col("n"), F.lit(0)), F.lit(0.0)
    words = made.where("word IS NOT NULL").select("_row", "word", "tf").join(model.words, "word", "left")
    parts = words.select("_row", F.when(seen > 0, F.col("tf")).otherwise(0).alias("k"), (F.col("tf") * F.log10((seen + 0.1) / size)).alias("b"), nothing.alias("s"))
    if isinstance(model.tree, Known):
        rest = made.where("code IS NOT NULL").select("_row", "code", "tf")
        every = model.codes.select("code", "n", F.lit(False).alias("want")).unionByName(rest.select("code").distinct().select("code", F.lit(0).cast("long").alias("n"), F.lit(True).alias("want")))
        found = rest.join(_log10_of(every, model.tree.depth, model.tree.top), "code")
        parts = parts.unionByName(found.select("_row", F.lit(0).cast("long").alias("k"), nothing.alias("b"), (F.col("tf") * F.col("p")).alias("s")))
    sums = parts.groupBy("_row").agg(*[F.sum(c).alias(f"_{c}") for c in "kbs"])
    score = F.col("_score") + F.coalesce(F.col("_s"), nothing)
    return made.where("tf IS NULL").drop(*tail).join(sums, "_row", "left").select(
        *[c for c in kept if c != "_row"],
        "n_tokens",
        (F.col("_head") + F.coalesce(F.col("_k"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce(F.col("_b"), nothing)).alias("base_score"),
        score.alias("score"),
        (-score / _LOG10_2 / F.col("_size")).alias("bits_per_byte"),
    )
