"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by k = floor(rate * m) edits.  It is
split into k + 1 pieces; k edits leave one piece whole, so every occurrence
holds an exact piece hit.  One automaton finds all piece hits of a text in one
pass; windows around them are verified with Myers' bit-parallel distance.

Texts and items are compared in lower case with runs of white space as one
space.  Defined cases: null or empty texts and items match nothing; an item
below ``1 / rate`` characters must occur exactly; equal items each match;
repeated rows each give their rows; ids keep their types; other columns are
ignored, and kept by :func:`decontaminate` whatever their names.  The test set
is a stated query set: it passes through the driver in blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The test set is a stated query set.  It goes to the workers in blocks of so many characters.
BLOCK_CHARS = 4_000_000


class Item(NamedTuple):
    id: object
    text: str
    budget: int


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget + 1`` pieces of almost equal length."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def ends(pattern: str, text: str, most: int) -> list[tuple[int, int]]:
    """(end, distance) wherever ``pattern`` ends in ``text`` within ``most`` edits: Myers' algorithm."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | down
        eq = ((eq & up) + up ^ up) | eq
        more, less = (down | ~(eq | up)) & full, up & eq
        if more & top:
            score += 1
        if less & top:
            score -= 1
        more, less = more << 1, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
        if score <= most:
            out.append((j + 1, score))
    return out


def best_match(item: Item, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest occurrence within text[lo:hi], the first among equals."""
    window = text[lo:hi]
    at = window.find(item.text)
    if at >= 0:
        return 0, lo + at, lo + at + len(item.text)
    found = ends(item.text, window, item.budget)
    if not found:
        return None
    end, distance = min(found, key=lambda x: (x[1], x[0]))
    back = ends(item.text[::-1], window[:end][::-1], distance)
    start = end - min(e for e, d in back if d == distance)
    return distance, lo + start, lo + end


class Matcher:
    """All items of a block, their pieces in one automaton."""

    def __init__(self, items: list[Item]) -> None:
        self.items, places = items, defaultdict(list)
        for n, item in enumerate(items):
            for offset, piece in pieces(item.text, item.budget):
                places[piece].append((n, offset))
        self.found = ahocorasick.Automaton()
        for piece, where in places.items():
            self.found.add_word(piece, (len(piece), where))
        if places:
            self.found.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end): the best occurrence of each item."""
        if not len(self.found) or not text:
            return []
        near = defaultdict(set)
        for end, (size, where) in self.found.iter(text):
            for n, offset in where:
                near[n].add(end + 1 - size - offset)
        out = []
        for n, diagonals in near.items():
            item, best = self.items[n], None
            m, k = len(item.text), item.budget
            lo = hi = -1
            for d in [*sorted(diagonals), None]:  # windows that overlap are verified as one
                if d is not None and lo >= 0 and d - k <= hi:
                    hi = d + m + k
                    continue
                if lo >= 0 and (got := best_match(item, text, lo, hi)) and (best is None or got < best):
                    best = got
                if d is not None:
                    lo, hi = max(0, d - k), d + m + k
            if best:
                out.append((n, *best))
        return sorted(out)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float) -> Iterator[list[Item]]:
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        text = normal(row.t)
        if text:
            block.append(Item(row.i, text, int(rate * len(text))))
            size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each text and item it holds: (id, item_id, distance, budget, start, end).

    start and end count characters of the normalised text.  No shuffle: each
    block of items passes over the texts once.
    """
    types = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"id {types[0].simpleString()}, item_id {types[1].simpleString()}, distance int, budget int, start int, end int"
    names = ["id", "item_id", "distance", "budget", "start", "end"]
    kinds = [*map(to_arrow_type, types), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, rate):

        def run(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in batches:
                rows = [(i, items[n].id, d, items[n].budget, a, b) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, d, a, b in matcher.matches(normal(t))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = source.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay.

    The matcher runs where the rows are, so nothing is joined or shuffled.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("string").alias("_text"))
    for items in _blocks(benchmark, "item_id", "text", rate):

        def run(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(normal(t)) for t in batch.column(1).to_pylist()], pa.bool_()))

        packed = packed.mapInArrow(run, packed.schema)
    return packed.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
