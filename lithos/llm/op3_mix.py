"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a fixed pseudo-random order, are cut into blocks of
about ``block`` units.  With a source's exact share w of all weights, its block
j is released at slot floor(j / w) and due at slot ceil((j + 1) / w); in every
slot the released block with the earliest deadline is sent (ties: the earlier
source).  So each source is less than one block off its weight at any time.
Shares are fractions, never rounded.

A source that ends leaves its weight to the others in proportion, and a new
phase starts, until all rows are placed: none is dropped or repeated.  The
schedule is made on the driver and has at most ``MOST_BLOCKS`` slots and one
for each source: where all units together would give more, blocks are larger
by as much.  A slot in which no row starts is filled by a row that is longer
than a block and started in an earlier block of its source.

Defined cases: null sources form one source (named null); sources without a
target weight share the mean weight; a weight that is not a positive finite
number is refused; rows that agree in id and text are placed next to each other
in some order; an empty table gives none; sizes below one or null count as one
unit; columns named block and slot are replaced, all others stay, whatever
their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key

#: Characters of a block when sizes are characters.
BLOCK_CHARS = 1 << 16
#: Blocks that the driver schedules.
MOST_BLOCKS = 1 << 20
#: Rows of one sorted run when rows are numbered, and runs that are summed in one task.
RUN_ROWS, RUNS = 1024, 10
#: Slots in one row of the table that places blocks.
SLOTS_ROW = 256


def checked(weights: Mapping) -> dict:
    """Weights as exact fractions; one that is not a positive finite number is refused."""
    for s, w in weights.items():
        if not (w > 0 and math.isfinite(w)):
            raise ValueError(f"the weight of {s!r} is {w}: weights must be positive and finite")
    return {s: Fraction(w) for s, w in weights.items()}


def parts(weights: Mapping) -> dict:
    """Weights as whole numbers in exactly the same proportions."""
    exact = checked(weights)
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def schedule(blocks: Mapping, weights: Mapping) -> tuple[dict, list]:
    """The slots of each source's blocks, and the first slot of each phase."""
    share = parts(weights)
    order = {s: i for i, s in enumerate(weights)}
    left, at, slot, starts = {s: n for s, n in blocks.items() if n}, {s: [] for s in blocks}, 0, []
    while left:
        starts.append(slot)
        total, t, ended = sum(share[s] for s in left), 0, False
        ready = [(_due(0, total, share[s]), order[s], s, 0) for s in left]
        waiting: list[tuple[int, int, object, int]] = []
        heapq.heapify(ready)
        while not ended:
            while waiting and waiting[0][0] <= t:
                _, i, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (_due(j, total, share[s]), i, s, j))
            _, i, s, j = heapq.heappop(ready)
            at[s].append(slot)
            slot, t = slot + 1, t + 1
            left[s] -= 1
            if left[s]:
                heapq.heappush(waiting, ((j + 1) * total // share[s], i, s, j + 1))
            else:
                del left[s]
                ended = True
    return at, starts


def _due(j: int, total: int, share: int) -> int:
    """The slot by whose end block j must be sent."""
    return -(-(j + 1) * total // share)


def _units(size: Column) -> Column:
    return F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1))


def _name(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))


def numbered(rows: DataFrame, source: str, size: Column, id_col: str, text_col: str) -> DataFrame:
    """(_row: all columns, _source, _start: units before the row in its source).

    Rows are ordered by a hash.  Hash ranges of about RUN_ROWS rows are summed
    first, and ranges of 2**RUNS of those before them, so that a source of any
    share of the rows is sorted and summed in many tasks.
    """
    rows = rows.select(F.struct("*").alias("_row"), _name(source).alias("_source"), _units(size).alias("_units"), *row_key(id_col, text_col))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(41), "_k1", "_k2"))
    counts = rows.groupBy("_source").count().withColumn("_bits", F.ceil(F.log2(F.greatest(F.col("count") / RUN_ROWS, F.lit(1.0)))).cast("int")).select("_source", "_bits")
    # the driver holds a weight for each source, so sources are sent whole
    rows = rows.join(F.broadcast(counts), "_source").withColumn("_run", F.expr("shiftright(_hash, 64 - greatest(_bits, 1)) + (1 << greatest(_bits - 1, 0))"))
    runs = rows.groupBy("_source", "_run").agg(F.sum("_units").alias("_sum")).withColumn("_top", F.shiftright("_run", RUNS))
    tops = runs.groupBy("_source", "_top").agg(F.sum("_sum").alias("_all"))

    def before(value: str, by: list[str], order: list[str]) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = tops.select("_source", "_top", before("_all", ["_source"], ["_top"]).alias("_far"))
    runs = runs.withColumn("_near", before("_sum", ["_source", "_top"], ["_run"])).join(tops, ["_source", "_top"])
    runs = runs.select("_source", "_run", (F.col("_far") + F.col("_near")).alias("_before"))
    out = rows.withColumn("_inside", before("_units", ["_source", "_run"], ["_hash", "_k1", "_k2"]))
    return out.join(runs, ["_source", "_run"]).select("_row", "_source", (F.col("_before") + F.col("_inside")).alias("_start"))


def mix(rows: DataFrame, weights: Mapping[str | None, float | Fraction] | None = None, block: int = 1 << 16, source: str = "source", size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", temperature: float | None = None) -> DataFrame:
    """All columns of ``rows`` and block (number in its source), slot (place in the mixture).

    Without weights a source weighs as much as its units to the power of
    ``temperature``, or all the same without that too.  ``size`` gives a row's
    units (default: 1, so blocks of that many rows).  A row belongs to the
    block in which it starts.
    """
    size = F.lit(1) if size is None else size
    ranked = numbered(rows, source, size, id_col, text_col)
    totals = {r[0]: r[1] for r in rows.select(_name(source).alias("s"), _units(size).alias("u")).groupBy("s").agg(F.sum("u")).orderBy("s").collect()}
    given = {"\u0000" if k is None else k: v for k, v in (weights or {}).items()}
    if given:
        mean = sum(checked(given).values()) / len(given)
        given = {s: given.get(s, mean) for s in totals}
    else:
        given = {s: 1 if temperature is None else float(n) ** temperature for s, n in totals.items()}
    block = max(int(block), -(-sum(totals.values()) // MOST_BLOCKS))
    at, _ = schedule({s: -(-n // block) for s, n in totals.items()}, given)
    names, chunks, slots = [], [], []
    for s, where in at.items():
        for i in range(0, len(where), SLOTS_ROW):
            names.append(s)
            chunks.append(i // SLOTS_ROW)
            slots.append(where[i : i + SLOTS_ROW])
    table = pa.table({"_source": pa.array(names, pa.string()), "_chunk": pa.array(chunks, pa.int64()), "_slots": pa.array(slots, pa.list_(pa.int64()))})
    placed = ranked.select("_row", "_source", F.expr(f"_start div {block}").alias("_block")).withColumn("_chunk", F.expr(f"_block div {SLOTS_ROW}"))
    placed = placed.join(F.broadcast(rows.sparkSession.createDataFrame(table)), ["_source", "_chunk"])  # eight bytes a slot
    kept = [F.col(f"_row.`{c}`") for c in rows.columns if c.lower() not in ("block", "slot")]
    return placed.select(*kept, F.col("_block").alias("block"), F.get(F.col("_slots"), F.expr(f"cast(_block % {SLOTS_ROW} AS int)")).alias("slot"))
