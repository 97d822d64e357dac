"""N-gram Jaccard join with count-vector trees.

A document's set holds its distinct 5-word shingles (64-bit hashes; the whole
word sequence when it has fewer words).  Two documents link when the Jaccard
similarity of their sets is at least ``threshold`` percent.

1. Documents with equal sets form one class; only classes are compared.
2. Classes are packed under their rarest shingles: similar sets must share one
   of their ``n - ceil(t n) + 1`` first shingles in any global order.  Rare ones
   come first (a bounded table of frequent hash buckets tells), so passages that
   many documents share rarely lead a block.
3. In small blocks all pairs are candidates, in large ones first the pairs with
   one member as the centre.
4. Shingles are hashed into groups and group counts are points; the summed
   coordinate minima bound the overlap.  Pairs within the bound are verified
   with the sets.
5. What large blocks still leave unconnected goes through an R-tree of several
   levels over the points, bulk-loaded by sort-tile-recursive packing, whose
   boxes bound the overlap of whole nodes; survivors are verified.  So no component is split;
   of a large block's links those that connect it are told, not all.

Hence the tree is not the only source of pairs, as the method's name would have
it.  One tree over all classes was measured first (README): its boxes let a
search pass by only 2 to 7 % of the leaves of like size with 8 to 128 groups,
so that its work grows with the square of the classes, while the points
themselves tell pairs apart well.  So the blocks are the upper level, whose
condition is exact, and the points bound every pair below it.

Defined cases: null, empty and wordless texts have the empty set, link with
nothing and are their own component; ids keep their type and are ordered by it;
a null id never becomes a component id unless all ids of the component are
null; repeated rows are members of one class; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, row_key, text_of

WORDS, THRESHOLD = 5, 80
GROUPS = 128
#: Blocks up to this size are compared pair by pair at once.
SMALL = 12
#: Bits of the table of hash buckets, and buckets in one of its rows.
BUCKET_BITS, BUCKET_ROW = 20, 4096
#: Members of one leaf task of the tree join.
LEAF_ROWS = 1024
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS, cache: _Hashes | None = None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    cache = _Hashes() if cache is None else cache
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    total = h[: len(h) - words + 1] * _MIX[0]
    for i in range(1, words):
        total += h[i : len(h) - words + 1 + i] * (_MIX[i % 5] + np.uint64(2 * i))
    total = np.sort(_spread(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _points(sets: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Shingles in each group; a group is the shingles that share their first bits."""
    return np.bincount((sets >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype("<u4")


def _fine(sets: np.ndarray) -> np.ndarray:
    """The point in so many groups that each holds four to eight shingles: a fraction of the set's bytes.

    With fewer groups the minima of unrelated long texts would add up to almost all of either.
    """
    return _points(sets, 1 << max(GROUPS.bit_length() - 1, (len(sets) // 8).bit_length())).astype("<u4")


def _digest(sets: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(sets.tobytes(), seed=len(sets))], np.uint64).view(np.int64)[0])


def members(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind 0: id, row key, n, digest, points; kind 1: a row of the bucket table as bucket and points)."""
    source = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), text_of(text_col).alias("_text"))

    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, load = _Hashes(), np.zeros(1 << BUCKET_BITS, np.int64)
        names = ["kind", "bucket", "id", "_k1", "_k2", "n", "digest", "points"]
        for batch in batches:
            n, digest, points, pending = [], [], [], []
            for text in batch.column(3).to_pylist():
                s = shingles(text, words, cache)
                pending.append(s)
                n.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                points.append(_fine(s).tobytes() if len(s) else None)
            some = np.concatenate([*pending, np.zeros(0, np.uint64)])
            load += np.bincount((some >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
            kind = pa.array(np.zeros(len(n), np.int32))
            yield pa.RecordBatch.from_arrays([kind, pa.nulls(len(n), pa.int64()), *batch.columns[:3], pa.array(n, pa.int32()), pa.array(digest, pa.int64()), pa.array(points, pa.binary())], names)
        rows = load.astype("<u4").reshape(-1, BUCKET_ROW)
        used = np.flatnonzero(rows.any(axis=1))
        gone = [pa.nulls(len(used), t) for t in (to_arrow_type(id_type), pa.string(), pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int32)), pa.array(used), *gone, pa.array([rows[i].tobytes() for i in used], pa.binary())], names)

    return source.mapInArrow(run, f"kind int, bucket bigint, id {id_type.simpleString()}, _k1 string, _k2 bigint, n int, digest bigint, points binary")


def _levels(made: DataFrame) -> np.ndarray:
    """How far each bucket's count is above what chance deals it, in half octaves; 0 for most."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKET_ROW, np.int64)
        for row in table["points"]:
            total += np.frombuffer(row.as_py(), "<u4")
        return pa.table({"bucket": table["bucket"][:1], "total": pa.array([total.tobytes()], pa.binary())})

    rows = made.where("kind = 1").select("bucket", "points").groupBy("bucket").applyInArrow(add, "bucket bigint, total binary").toArrow()  # 2**BUCKET_BITS counts
    count = np.zeros((1 << BUCKET_BITS) // BUCKET_ROW * BUCKET_ROW).reshape(-1, BUCKET_ROW)
    for i, total in zip(rows["bucket"].to_pylist(), rows["total"].to_pylist(), strict=True):
        count[i] = np.frombuffer(total, np.int64)
    count = count.reshape(-1)
    usual = float(np.median(count))
    usual += 4 * np.sqrt(usual) + 1
    return np.where(count > usual, np.minimum(250, 1 + 2 * np.log2(np.maximum(count, usual) / usual)), 0).astype(np.uint8)


def prefix(sets: np.ndarray, level: np.ndarray, threshold: int) -> np.ndarray:
    """The first shingles in the global order: rarer buckets first, then by hash."""
    n = len(sets)
    keep = n - -(-threshold * n // 100) + 1
    rank = level[(sets >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    return sets[np.argsort(rank, kind="stable")[:keep]] if rank.any() else sets[:keep]


def _postings(docs: DataFrame, level: np.ndarray, words: int, threshold: int, text_col: str) -> DataFrame:
    """(h, digest, n): each class under its first shingles; a class may come from several tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(level)  # one byte for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = _Hashes(), set()
        for batch in batches:
            out, digests, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, words, cache)
                d = _digest(s) if len(s) else 0
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                out.append(prefix(s, sent.value, threshold))
                digests.append(d)
                sizes.append(len(s))
            if out:
                each = [len(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(digests, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["h", "digest", "n"])

    return docs.select(text_of(text_col).alias("_text")).mapInArrow(run, "h bigint, digest bigint, n int")


def _blocks(postings: DataFrame, threshold: int) -> DataFrame:
    """From postings in order of (h, digest): candidate pairs (kind 0), members of large or
    split blocks (kind 1), centres of blocks at a partition's edge (kind 2).

    The range partitions cut through blocks, so a block of any size is dealt out evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "h", "a", "b"]

        def out(kind: int, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(h), pa.array(a), pa.array(b)], names)

        def near(n: np.ndarray, m: np.ndarray) -> np.ndarray:
            return 100 * np.minimum(n, m) >= threshold * np.maximum(n, m).astype(np.int64)

        def emit(h: np.ndarray, d: np.ndarray, n: np.ndarray, centre: tuple | None, edge: bool) -> Iterator[pa.RecordBatch]:
            """Of whole blocks; ``centre`` (h, digest, n) carries a block on, ``edge`` makes the first one split."""
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(start, len(h)))
            block = np.repeat(np.arange(len(start)), size)
            large = size > SMALL
            if edge or centre is not None:
                large[0] = True
            on = large[block]
            if on.any():
                yield out(1, h[on], d[on], n[on].astype(np.int64))
                lead = start[block]
                a, an = d[lead].copy(), n[lead].copy()
                if centre is not None:
                    a[block == 0], an[block == 0] = centre[1], centre[2]
                keep = on & (a != d) & near(n, an)
                if keep.any():
                    yield out(0, h[keep], np.minimum(a, d)[keep], np.maximum(a, d)[keep])
            for step in range(1, SMALL):
                i = np.flatnonzero(~on[:-step] & (block[step:] == block[:-step])) if len(h) > step else []
                if not len(i):
                    break
                i = i[near(n[i], n[i + step])]
                if len(i):
                    yield out(0, h[i], np.minimum(d[i], d[i + step]), np.maximum(d[i], d[i + step]))

        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        centre, first = None, True
        for batch in batches:
            h, d, n = (np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns, strict=True))
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d, n = h[fresh], d[fresh], n[fresh]
            last = int(np.searchsorted(h, h[-1]))  # where the block that may go on starts
            if last == 0 and len(h) > 20_000:  # one long block: pass it on, keep its centre and last member
                if centre is None or centre[0] != h[0]:
                    if not first:
                        yield out(2, h[:1], d[:1], n[:1].astype(np.int64))
                    centre = (h[0], d[0], n[0])
                    if first:
                        yield out(2, h[:1], d[:1], n[:1].astype(np.int64))
                yield from emit(h[:-1], d[:-1], n[:-1], centre, True)
                kept = (h[-1:], d[-1:], n[-1:])
                first = False
                continue
            if last:
                if first:
                    yield out(2, h[:1], d[:1], n[:1].astype(np.int64))
                same = centre if centre is not None and centre[0] == h[0] else None
                yield from emit(h[:last], d[:last], n[:last], same, first)
                centre = None
                first = False
            kept = (h[last:], d[last:], n[last:])
        if len(kept[0]):
            h, d, n = kept
            yield out(2, h[:1], d[:1], n[:1].astype(np.int64))
            yield from emit(h, d, n, centre if centre is not None and centre[0] == h[0] else None, True)

    ordered = postings.repartitionByRange("h", "digest").sortWithinPartitions("h", "digest")
    return ordered.mapInArrow(run, "kind int, h bigint, a bigint, b bigint")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Summed minima of two points; the finer one is folded to the groups of the other."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.minimum(x.reshape(len(y), -1).sum(axis=1), y).sum())


def _bounded(pairs: DataFrame, points: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose summed coordinate minima allow enough overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                keep.append((100 + threshold) * _overlap(x, y) >= threshold * (int(x.sum()) + int(y.sum())))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(points.select(F.col("digest").alias("a"), F.col("points").alias("pa")), "a").join(points.select(F.col("digest").alias("b"), F.col("points").alias("pb")), "b")
    return both.select("a", "b", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose sets are similar.  One document of each class concerned lends its text."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(classes, "digest").select("digest", "_k1", "_k2")
    texts = docs.select(*row_key(id_col, text_col), text_of(text_col).alias("_text")).join(need.hint("shuffle_hash"), ["_k1", "_k2"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words, cache).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["digest", "s"])

    # a row that is there twice lends its text twice
    found = cut(texts.select("digest", "_text").mapInArrow(sets, "digest bigint, s binary").groupBy("digest").agg(F.max("s").alias("s")), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= threshold * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(found.select(F.col("digest").alias("a"), F.col("s").alias("sa")), "a").join(found.select(F.col("digest").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches.

    Least labels travel along the edges and along the labels themselves; each
    round is a written table, so an executor that is lost costs one round.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, labels.node == near.a, "left").select("node", "root", F.least("root", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("root").alias("above"))
        moved = cut(moved.join(up, "new", "left").select("node", "root", F.least("new", "above").alias("new")), "labels")
        if moved.where("root <> new").isEmpty():
            return moved.select("node", F.col("new").alias("root"))
        labels = moved.select("node", F.col("new").alias("root"))


class Tree:
    """An R-tree of count vectors, packed by sort-tile-recursive order, of as many levels as it takes.

    Each node has the greatest count of each group below it and the least sum;
    level 0 holds the nodes above the points, the last level the root.
    """

    def __init__(self, points: np.ndarray, fan: int = 32) -> None:
        total = points.sum(axis=1)
        spread = np.argsort(-points.var(axis=0))[:2]
        band = np.argsort(total, kind="stable")
        slabs = max(1, round(np.sqrt(len(points) / fan)))
        order = [s[np.lexsort(points[s][:, spread].T)] for s in np.array_split(band, slabs) if len(s)]
        self.points, self.children, self.high, self.least = points, [], [], []
        below, high, least = np.concatenate(order), points, total
        while not self.children or len(self.children[-1]) > 1:
            nodes = np.array_split(below, max(1, -(-len(below) // fan)))
            high, least = np.stack([high[x].max(axis=0) for x in nodes]), np.array([least[x].min() for x in nodes])
            self.children.append(nodes)
            self.high.append(high)
            self.least.append(least)
            below = np.arange(len(nodes))
        self.opened = 0

    def search(self, q: np.ndarray, threshold: int) -> np.ndarray:
        """Points whose summed coordinate minima with ``q`` reach the least overlap."""
        size, at = q.sum(), np.zeros(1, np.int64)
        for children, high, least in zip(reversed(self.children), reversed(self.high), reversed(self.least), strict=True):
            at = at[(100 + threshold) * np.minimum(high[at], q).sum(axis=1) >= threshold * (size + least[at])]
            if not len(at):
                return at
            self.opened += len(at)
            at = np.concatenate([children[i] for i in at])
        p = self.points[at]
        return at[(100 + threshold) * np.minimum(p, q).sum(axis=1) >= threshold * (size + p.sum(axis=1))]


def _common(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending arrays share a value."""
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(x, y)
    return bool((x[np.minimum(at, len(x) - 1)] == y).any())


def _left(blocks: DataFrame, roots: DataFrame, points: DataFrame, threshold: int) -> DataFrame:
    """Pairs of unconnected members of one block that a tree over the block lets through.

    A row carries its class's earlier blocks, so that a pair is told in the
    first block that both are in and in no other.  They are no more than the
    prefix of one text.
    """
    rows = blocks.where("kind = 1").select("h", F.col("a").alias("digest")).distinct()
    rows = rows.join(roots, rows.digest == roots.node, "left").select("h", "digest", F.coalesce("root", "digest").alias("root"))
    split = rows.groupBy("h").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("h", F.ceil(F.col("m") / LEAF_ROWS).cast("int").alias("parts"))
    split = cut(split, "split")  # written, so that the join alone meets a block's size and is split at run time
    rows = cut(rows.join(split, "h"), "members")
    points = points.join(rows.groupBy("digest").agg(F.sort_array(F.collect_list("h")).alias("all")), "digest")
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("h", F.least("leaf", "other").alias("i"), F.greatest("leaf", "other").alias("j"), "leaf", "digest", "root").join(points, "digest")
    rows = rows.withColumn("before", F.filter("all", lambda x: x < F.col("h"))).drop("all")

    def run(table: pa.Table) -> pa.Table:
        leaf, digest, root = (table[c].to_numpy() for c in ("leaf", "digest", "root"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        fine = [np.frombuffer(x, "<u4").astype(np.int64) for x in table["points"].to_pylist()]
        before = [x.values.to_numpy() for x in table["before"]]
        p = np.stack([x.reshape(GROUPS, -1).sum(axis=1) for x in fine])
        inner, outer = np.flatnonzero(leaf == i), np.flatnonzero(leaf == j)
        a, b = [], []
        if len(inner) and len(outer):
            tree = Tree(p[inner])
            for x in outer.tolist():
                at = inner[tree.search(p[x], threshold)]
                at = at[(root[at] != root[x]) & ((digest[at] < digest[x]) | (i != j))]
                at = np.array([y for y in at.tolist() if not _common(before[x], before[y]) and (100 + threshold) * _overlap(fine[x], fine[y]) >= threshold * int(p[x].sum() + p[y].sum())], np.int64)
                a += np.minimum(digest[at], digest[x]).tolist()
                b += np.maximum(digest[at], digest[x]).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("h", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


class Join:
    """The join's parts: ``rows`` (id, row key, n, digest), ``links`` (a, b) between classes, ``roots`` of classes.

    ``links`` is a subset of all links that connects every component: in blocks of
    more than SMALL members, pairs that are connected already are not verified.
    """

    def __init__(self, docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> None:
        made = cut(members(docs, words, id_col, text_col), "members")
        self.rows = made.where("kind = 0").drop("kind", "bucket")
        level = _levels(made)
        full = self.rows.where("n > 0")
        classes = full.groupBy("digest").agg(F.min(F.struct("_k1", "_k2")).alias("k")).select("digest", "k._k1", "k._k2")
        points = full.groupBy("digest").agg(F.max("points").alias("points"))
        postings = cut(_postings(docs, level, words, threshold, text_col), "postings")
        blocks = cut(_blocks(postings, threshold), "blocks")
        edge = blocks.where("kind = 2").groupBy("h").agg(F.min("a").alias("lead"))
        split = blocks.where("kind = 2").join(edge, "h").where("a <> lead").select(F.least("a", "lead").alias("a"), F.greatest("a", "lead").alias("b"))
        pairs = cut(_bounded(blocks.where("kind = 0").select("a", "b").union(split).distinct(), points, threshold), "pairs")
        links = cut(_verified(pairs, docs, classes, words, threshold, id_col, text_col), "links")
        self.roots = components(links)
        more = cut(_left(blocks, self.roots, points, threshold), "left")
        if not more.isEmpty():
            fresh = cut(_verified(more, docs, classes, words, threshold, id_col, text_col), "links")
            links = links.unionByName(fresh)
            if not fresh.isEmpty():
                self.roots = components(links)
        self.links = links

    def components(self) -> DataFrame:
        """(id, _k1, _k2, n_shingles, component_id) of every row."""
        full, empty = self.rows.where("n > 0"), self.rows.where("n = 0")
        per = full.groupBy("digest").agg(F.min("id").alias("id"))
        rooted = per.join(self.roots, per.digest == self.roots.node, "left").select("digest", "id", F.coalesce("root", "digest").alias("root"))
        rooted = cut(rooted, "rooted")
        # written, so that a large component or a much copied text is a skewed key of a join alone, which is split at run time
        least = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
        named = cut(rooted.join(least, "root").select("digest", "component_id"), "named")
        size = F.col("n").cast("long").alias("n_shingles")
        return full.join(named, "digest").select("id", "_k1", "_k2", size, "component_id").unionByName(empty.select("id", "_k1", "_k2", size, F.col("id").alias("component_id")))
