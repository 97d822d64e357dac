"""Similarity joins: TLSH distance and piecewise-hash score, each behind an exact condition.

TLSH: codes of length and ratios that differ too much already cost more than the
threshold, so probes meet only entries of near length codes, in blocks that
compare bits.  Piecewise hashes: a score above zero needs a shared 7-gram at
fitting block sizes, so candidates come from an equi-join on (block size, gram).
Neither loses a pair.  The top k per probe is a window over the survivors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import ctph, tlsh
from lithos.functions.digests import size_band


def _near(centre: Column, d: int, size: int) -> Column:
    """All numbers 0..size-1 within d on the circle."""
    if 2 * d + 1 >= size:
        return F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(F.sequence(F.lit(-d), F.lit(d)), lambda x: F.pmod(centre + x, F.lit(size)))


def tlsh_candidates(probes: DataFrame, library: DataFrame, threshold: int = 40) -> DataFrame:
    """Pairs (probe columns, entry columns as e_*) that pass the necessary condition."""
    length, ratio = tlsh.reach(threshold)
    p = probes.withColumns({f"p_{k}": v for k, v in tlsh.header(F.col("tlsh")).items()})
    p = p.withColumn("_lv", F.explode(_near(F.col("p_lv"), length, 256))).withColumn("_q1", F.explode(_near(F.col("p_q1"), ratio, 16)))
    e = library.select(*[F.col(c).alias(f"e_{c}") for c in library.columns])
    e = e.withColumns({f"x_{k}": v for k, v in tlsh.header(F.col("e_tlsh")).items()})
    joined = p.join(e, (F.col("_lv") == F.col("x_lv")) & (F.col("_q1") == F.col("x_q1")))
    return joined.where((tlsh.circular(F.col("p_q2"), F.col("x_q2"), 16) <= ratio) & (F.col("tlsh") != F.col("e_tlsh"))).drop("_lv", "_q1", "p_lv", "p_q1", "p_q2", "x_lv", "x_q1", "x_q2")


#: Digests of a block of probes, and of entries of one length code, that meet in one group.
PROBES, ENTRIES = 1 << 15, 1 << 16


def _tlsh_pairs(probes: DataFrame, entries: DataFrame, threshold: int, k: int | None = None) -> DataFrame:
    """(tlsh, before, e_tlsh, distance) of all pairs of digests within the threshold, or of the ``k`` least of each probe.

    ``probes`` are (tlsh, before), ``entries`` (tlsh, since), each once; a probe
    meets entries with ``since < before``.  Entries of one length code meet the
    probes of the codes within reach.  Both sides are dealt into blocks, so a
    group is bounded however many digests share a code, and a group hands on
    ``k`` entries of a probe at most.
    """
    lv = tlsh.header(F.col("tlsh"))["lv"].alias("lv")
    p, e = probes.select(lv, "tlsh", "before"), entries.select(lv, "tlsh", "since")
    counts = p.groupBy(F.lit(0).alias("side"), "lv").count().unionByName(e.groupBy(F.lit(1).alias("side"), "lv").count()).collect()
    s = -(-sum(r["count"] for r in counts if r["side"] == 0) // PROBES) or 1
    t = -(-max([r["count"] for r in counts if r["side"] == 1], default=1) // ENTRIES)
    deal = lambda n: F.pmod(F.xxhash64("tlsh"), F.lit(n)).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length, _ = tlsh.reach(threshold)
    p = p.select(F.explode(_near(F.col("lv"), length, 256)).alias("lv"), deal(s).alias("i"), F.unhex("tlsh").alias("p"), "before").select("*", blocks(t).alias("j"))
    e = e.select("lv", deal(t).alias("j"), F.unhex("tlsh").alias("e"), "since").select("*", blocks(s).alias("i"))
    rows = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 35)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("p"), right.column("e")
        x, y, d = (np.zeros(0, np.int64),) * 3
        if len(a) and len(b):
            x, y, d = tlsh.nearest(rows(a), rows(b), threshold, k, left.column("before").to_numpy(), right.column("since").to_numpy())
        return pa.table({"p": a.take(pa.array(x)), "before": left.column("before").take(pa.array(x)), "e": b.take(pa.array(y)), "distance": pa.array(d, pa.int32())})

    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data, much work: not merged
    by = lambda frame: frame.repartition(n, "lv", "i", "j").groupBy("lv", "i", "j")
    found = by(p).cogroup(by(e)).applyInArrow(run, "p binary, before bigint, e binary, distance int")
    return found.select(F.hex("p").alias("tlsh"), "before", F.hex("e").alias("e_tlsh"), "distance")


def _digests(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("tlsh").rlike("^[0-9A-F]{70}$"))


def _entries(library: DataFrame) -> DataFrame:
    return library.select(*[F.col(c).alias(f"e_{c}") for c in library.columns])


def tlsh_join(probes: DataFrame, library: DataFrame, threshold: int = 40) -> DataFrame:
    """All pairs within the distance, with it; equal digests are left out."""
    each = lambda rows, name: _digests(rows).select("tlsh", F.lit(int(name == "before")).cast("bigint").alias(name)).distinct()
    pairs = _tlsh_pairs(each(probes, "before"), each(library, "since"), threshold).drop("before")
    return probes.join(pairs, "tlsh").join(_entries(library), "e_tlsh")


def top(pairs: DataFrame, probe: str | list[str], order: list[Column], k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(probe).orderBy(*order))).where(F.col("rank") <= k)


def tlsh_top(probes: DataFrame, library: DataFrame, probe: str, threshold: int = 40, k: int = 10) -> DataFrame:
    """The k closest entries of each probe; ties by digest, those of equal digests by the entry's other columns.

    Equal digests have the same neighbours and are compared once; of the entries
    of one digest the first k can be told.
    """
    ties = sorted((c for c in library.columns if c != "tlsh"), key=lambda c: c != "seq")
    each = lambda rows, name: _digests(rows).select("tlsh", F.lit(int(name == "before")).cast("bigint").alias(name)).distinct()
    pairs = _tlsh_pairs(each(probes, "before"), each(library, "since"), threshold, k).drop("before")
    pairs = top(pairs, "tlsh", [F.col("distance"), F.col("e_tlsh")], k).drop("rank")
    first = top(library, "tlsh", [F.col(c) for c in ties], k).drop("rank") if ties else library
    ranked = top(pairs.join(_entries(first), "e_tlsh"), "tlsh", [F.col("distance"), F.col("e_tlsh"), *[F.col(f"e_{c}") for c in ties]], k)
    return probes.join(ranked, "tlsh")


def tlsh_replay(arrivals: DataFrame, library: DataFrame, probe: str, threshold: int = 40, k: int = 10) -> DataFrame:
    """As :func:`tlsh_top`, but an arrival sees only entries with a smaller ``seq``; ties by digest, then ``seq``."""
    before, since = _digests(arrivals).select("tlsh", F.col("seq").alias("before")).distinct(), _digests(library).groupBy("tlsh").agg(F.min("seq").alias("since"))
    pairs = _tlsh_pairs(before, since, threshold, k).withColumnRenamed("before", "seq")
    pairs = top(pairs, ["tlsh", "seq"], [F.col("distance"), F.col("e_tlsh")], k).drop("rank")
    first = top(library, "tlsh", [F.col("seq")], k).drop("rank")  # the earliest are seen first
    seen = pairs.join(_entries(first), "e_tlsh").where(F.col("e_seq") < F.col("seq"))
    ranked = top(seen, ["tlsh", "seq"], [F.col("distance"), F.col("e_tlsh"), F.col("e_seq")], k)
    return arrivals.join(ranked, ["tlsh", "seq"])


def probe_grams(probes: DataFrame) -> DataFrame:
    """(probe columns, blocksize, gram): both parts at the own size, the first at half, the second at twice."""
    b = ctph.block_size(F.col("ssdeep"))
    one, two = ctph.grams(ctph.part(F.col("ssdeep"), 1)), ctph.grams(ctph.part(F.col("ssdeep"), 2))
    half = F.floor(b / 2)
    each = F.filter(F.array(F.struct(b.alias("b"), F.array_union(one, two).alias("g")), F.struct(half.alias("b"), one.alias("g")), F.struct((b * 2).alias("b"), two.alias("g"))), lambda x: x["b"] > 0)
    return probes.withColumn("_x", F.explode(each)).withColumn("gram", F.explode("_x.g")).withColumn("blocksize", F.col("_x.b")).drop("_x")


def entry_grams(library: DataFrame) -> DataFrame:
    both = F.array_union(ctph.grams(ctph.part(F.col("ssdeep"), 1)), ctph.grams(ctph.part(F.col("ssdeep"), 2)))
    return library.select(*[F.col(c).alias(f"e_{c}") for c in library.columns], ctph.block_size(F.col("ssdeep")).alias("blocksize"), F.explode(both).alias("gram"))


def gram_rarity(library: DataFrame) -> DataFrame:
    """(blocksize, gram, entries): how many entries hold each gram."""
    return entry_grams(library).groupBy("blocksize", "gram").agg(F.count("*").alias("entries"))


def _gram_places(digests: DataFrame, sides: Column) -> DataFrame:
    """(key, blocksize, gram, prev) of every place of a 7-gram; ``prev`` is the character before it, empty at the start.

    ``sides`` is an array of (b, h): parts of the hash, and the block size under which they are met.
    """
    rows = digests.select("key", F.explode(F.filter(sides, lambda x: x["b"] > 0)).alias("x")).select("key", F.col("x.b").alias("blocksize"), ctph.strip_runs(F.col("x.h")).alias("h"))
    rows = rows.where((F.length("h") >= ctph.WINDOW) & F.col("h").rlike("^[A-Za-z0-9+/]+$"))
    rows = rows.select("key", "blocksize", "h", F.explode(F.sequence(F.lit(1), F.length("h") - ctph.WINDOW + 1)).alias("i"))
    return rows.select("key", "blocksize", F.substring("h", F.col("i"), F.lit(ctph.WINDOW)).alias("gram"), F.when(F.col("i") > 1, F.substring("h", F.col("i") - 1, F.lit(1))).otherwise("").alias("prev"))


def _ssdeep_pairs(probes: DataFrame, library: DataFrame, probe: str, entry: str, size: str) -> DataFrame:
    """(ssdeep, e_ssdeep): pairs of differing digests that share a gram at fitting block sizes, once each; sizes of some rows fit.

    Equal digests are one row here.  A shared run of characters gives a pair
    where it begins and nowhere else: with the same character before both
    places the grams one place earlier are shared too.  Only keys travel with
    the grams; the digests are joined back afterwards.
    """
    classes = lambda rows, key: rows.where("ssdeep IS NOT NULL").groupBy("ssdeep").agg(F.min(key).alias("key"), F.min(size).alias("least"), F.max(size).alias("most"), F.max(F.col(size).isNull()).alias("open"))
    p, e = classes(probes, probe), classes(library, entry)
    b, one, two = ctph.block_size(F.col("ssdeep")), ctph.part(F.col("ssdeep"), 1), ctph.part(F.col("ssdeep"), 2)
    side = lambda at, part: F.struct(at.cast("bigint").alias("b"), part.alias("h"))
    left = _gram_places(p, F.array(side(b, one), side(b, two), side(F.floor(b / 2), one), side(b * 2, two)))
    right = _gram_places(e, F.array(side(b, one), side(b, two))).select(F.col("key").alias("e_key"), "blocksize", "gram", F.col("prev").alias("e_prev"))
    met = left.join(right, ["blocksize", "gram"]).where((F.col("prev") == "") | (F.col("prev") != F.col("e_prev"))).select("key", "e_key").distinct()
    full = met.join(p, "key").join(e.select(*[F.col(c).alias(f"e_{c}") for c in e.columns]), "e_key")
    sizes = F.col("open") | F.col("e_open") | (F.col("least") <= 0) | ((F.col("e_most") >= F.floor(F.col("least") / 2)) & (F.col("e_least") <= F.col("most") * 2))
    return full.where((F.col("ssdeep") != F.col("e_ssdeep")) & sizes).select("ssdeep", "e_ssdeep")


def _with_rows(pairs: DataFrame, probes: DataFrame, library: DataFrame, size: str) -> DataFrame:
    """The rows of both digests of each pair, where sizes fit."""
    return pairs.join(probes, "ssdeep").join(_entries(library), "e_ssdeep").where(size_band(F.col(f"e_{size}"), F.col(size)))


def ssdeep_candidates(probes: DataFrame, library: DataFrame, probe: str, entry: str, size: str = "size") -> DataFrame:
    """Pairs that share a gram at fitting block sizes and whose sizes fit, once each."""
    return _with_rows(_ssdeep_pairs(probes, library, probe, entry, size), probes, library, size)


def ssdeep_without_grams(probes: DataFrame, library: DataFrame, size: str = "size") -> DataFrame:
    """For probes too short for grams: all entries of a fitting block size and size."""
    b = ctph.block_size(F.col("ssdeep"))
    short = probes.where((F.size(ctph.grams(ctph.part(F.col("ssdeep"), 1))) == 0) & (F.size(ctph.grams(ctph.part(F.col("ssdeep"), 2))) == 0))
    short = short.withColumn("blocksize", F.explode(F.filter(F.array(b, F.floor(b / 2), b * 2), lambda x: x > 0)))
    entries = library.select(*[F.col(c).alias(f"e_{c}") for c in library.columns], ctph.block_size(F.col("ssdeep")).alias("blocksize"))
    return short.join(entries, "blocksize").drop("blocksize").where((F.col("ssdeep") != F.col("e_ssdeep")) & size_band(F.col(f"e_{size}"), F.col(size)))


def ssdeep_top(probes: DataFrame, library: DataFrame, probe: str, entry: str, threshold: int = 50, k: int = 5) -> DataFrame:
    """The k entries that score highest with each probe; ties by digest."""
    pairs = _ssdeep_pairs(probes, library, probe, entry, "size").withColumn("score", ctph.score_column(F.col("ssdeep"), F.col("e_ssdeep")))
    rows = _with_rows(pairs.where(F.col("score") >= threshold), probes, library, "size")
    return top(rows, probe, [F.desc("score"), F.col("e_ssdeep"), F.col(f"e_{entry}")], k)
