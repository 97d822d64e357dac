"""State of a scanning service as batch operators: limits, histories, caches, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp with or without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def rate_limited(events: DataFrame, key: str, ts: str, order: str, window: int = 60, limit: int = 30) -> DataFrame:
    """Adds ``accepted``: whether fewer than ``limit`` accepted events of the key lie within ``window`` seconds.

    Rejected events do not count, so each decision needs those before it.  But
    a gap of more than the window forgets everything: a key's events fall into
    sessions, and only a session is folded in order.
    """
    if limit <= 0:
        return events.withColumn("accepted", F.lit(True))
    second = micros(F.col(ts)) / F.lit(1e6)
    seen = events.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(order).alias("_order"), second.alias("_t"))
    before = Window.partitionBy("_key").orderBy("_t", "_order")
    seen = seen.withColumn("_new", F.coalesce(F.col("_t") - F.lag("_t").over(before) > window, F.lit(True)).cast("int"))
    seen = seen.withColumn("_session", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.struct(F.array().cast("array<double>").alias("kept"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.filter(acc["kept"], lambda t: x["_t"] - t <= window)
        ok = F.size(kept) < limit
        return F.struct(F.when(ok, F.concat(kept, F.array(x["_t"]))).otherwise(kept).alias("kept"), F.concat(acc["out"], F.array(ok)).alias("out"))

    # the rows travel with their times: null keys are one key, and equal rows stay as many as they are
    order_of = lambda a, b: F.when(a["_t"] < b["_t"], -1).when(a["_t"] > b["_t"], 1).when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0)
    folded = seen.groupBy("_key", "_session").agg(F.array_sort(F.collect_list(F.struct("_t", "_order", "_row")), order_of).alias("_e"))
    flags = F.aggregate(F.transform("_e", lambda x: F.struct(x["_t"].alias("_t"))), start, step, lambda a: a["out"])
    each = folded.select(F.explode(F.arrays_zip(F.transform("_e", lambda x: x["_row"]).alias("_row"), flags.alias("_ok"))).alias("_z"))
    return each.select("_z._row.*", F.col("_z._ok").alias("accepted"))


def capped_history(rows: DataFrame, key: str, order: list[str], most: int = 100) -> DataFrame:
    """The last ``most`` rows of each key."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def merged_history(stored: DataFrame, new: DataFrame, key: str, same: list[str], order: str, most: int = 100) -> DataFrame:
    """Stored rows, then new ones (the first of equals) that are not among them; the last ``most`` of each key."""
    fresh = new.groupBy(key, *same).agg(F.min(order).alias(order)).join(stored.select(key, *same).distinct(), [key, *same], "left_anti")
    both = stored.select(key, *same, order, F.lit(0).alias("_new")).unionByName(fresh.select(key, *same, order, F.lit(1).alias("_new")))
    return capped_history(both, key, ["_new", order], most).drop("_new")


def evicted_cache(entries: DataFrame, now: Column, ts: str, order: str, max_age: int = 30 * 86400, most: int = 10_000) -> DataFrame:
    """Entries that are not older than ``max_age`` seconds; of those the ``most`` newest.

    The bounded top-n finds the cut-off, so nothing is sorted in one task.
    """
    young = entries.where(micros(now) - micros(F.col(ts)) <= max_age * 1_000_000)
    keys = young.select(ts, order).orderBy(F.desc(ts), F.desc(order)).limit(most).agg(F.min(F.struct(ts, order)).alias("_cut"))
    return young.join(F.broadcast(keys), F.struct(ts, order) >= F.col("_cut")).drop("_cut")  # one row


def live_tasks(tasks: DataFrame, now: Column, ts: str, order: str, ttl: int = 600, most: int = 100) -> DataFrame:
    """Tasks within their time to live; of those the ``most`` newest."""
    return evicted_cache(tasks, now, ts, order, ttl, most)


def cached_or_new(submissions: DataFrame, reports: DataFrame, key: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """Submissions that have a report, with it, and the first of each that has none."""
    hit = submissions.join(reports, key)
    new = submissions.join(reports.select(key), key, "left_anti")
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), "submitted_at").alias("_f")).select(key, "_f.*")
    return hit, first


def nearest_rank(rows: DataFrame, value: str, percents: list[int], buckets: int = 64) -> DataFrame:
    """(percent, value): the value at index ``n * p // 100`` of the sorted values, exactly.

    Approximate quantiles only split the range; counts tell which part holds
    each rank, and only that part is numbered.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    cuts = rows.agg(F.array_distinct(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 1000)).alias("cuts"))
    placed = rows.join(F.broadcast(cuts)).select("v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))  # one row of cuts
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    sizes = sizes.select("part", "n", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    wanted = rows.sparkSession.createDataFrame([(p,) for p in percents], "percent int")
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * F.col("percent") / 100))
    wanted = sizes.join(F.broadcast(wanted)).withColumn("at", at).where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))
    # equal values stand together, so counts of values are numbered instead of rows
    values = placed.groupBy("part", "v").agg(F.count("*").alias("c"))
    values = values.join(F.broadcast(wanted.select("part").distinct()), "part", "left_semi")
    ends = values.withColumn("end", F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    found = ends.join(F.broadcast(wanted.select("part", "percent", (F.col("at") - F.col("before")).alias("k"))), "part").where((F.col("k") < F.col("end")) & (F.col("k") >= F.col("end") - F.col("c")))
    return found.select("percent", F.col("v").alias("value"))
