"""Exact lookups: equi-joins on a digest with the size rule as the residual condition.

No side is broadcast by hand: Spark broadcasts a store that is small by its
statistics, otherwise both sides shuffle on the digest, which spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.digests import fits, hash_kind
from lithos.functions.tlsh import normal

# Names of the engines in detections.
ENGINES = {"sha256": "SHA256 Hash DB", "md5": "MD5 Hash DB", "ssdeep": "SSDeep Hash DB", "tlsh": "TLSH Hash DB", "fuzzy": "Fuzzy Hash DB"}


def exact(probes: DataFrame, store: DataFrame, key: str, size: str | None = "size") -> DataFrame:
    """Probes with the signature (sig_size, sig_name) that their digest and size match."""
    sigs = store.select(F.col("hash").alias("_h"), F.col("size").alias("sig_size"), F.col("name").alias("sig_name"))
    rule = F.col(key) == F.col("_h")
    if size is not None:
        rule &= fits(F.col("sig_size"), F.col(size))
    return probes.join(sigs, rule).drop("_h")


def routed(hashes: DataFrame, sha256: DataFrame, md5: DataFrame, value: str = "value") -> DataFrame:
    """(value, kind, name): each hash looked up in the store that its length tells, without a size."""
    rows = hashes.select(F.col(value), F.lower(F.trim(F.col(value))).alias("_v"), hash_kind(F.col(value)).alias("kind"))
    stores = sha256.select(F.lit("sha256").alias("kind"), F.col("hash").alias("_v"), "name").unionByName(md5.select(F.lit("md5").alias("kind"), F.col("hash").alias("_v"), "name"))
    return rows.join(stores, ["kind", "_v"], "left").select(value, "kind", "name")


def fuzzy_exact(probes: DataFrame, store: DataFrame) -> DataFrame:
    """Probes (fuzzy_type, value, size) with signatures of the same type and value; the size rule holds."""
    sigs = store.select("fuzzy_type", "value", F.col("size").alias("sig_size"), F.col("name").alias("sig_name"), F.col("sha256").alias("sig_sha256"))
    return probes.join(sigs, ["fuzzy_type", "value"]).where(fits(F.col("sig_size"), F.col("size")))


def computed(samples: DataFrame, store: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples' import hashes, then authenticode hashes, looked up; empty ones are skipped."""
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("fuzzy_type"), F.nullif(F.col(k), F.lit("")).alias("value")) for i, k in enumerate(("imphash", "authentihash"))])
    rows = samples.select(key, "size", F.explode(each).alias("x")).select(key, "size", "x.*").where("value IS NOT NULL")
    return fuzzy_exact(rows, store)


def tlsh_exact(probes: DataFrame, library: DataFrame) -> DataFrame:
    """Probes (value) whose digest is in the library, in any case and with or without ``T1``; no size rule."""
    entries = library.select(F.col("tlsh").alias("_t"), F.col("name").alias("sig_name"))
    return probes.withColumn("_n", normal(F.col("value"))).join(entries, F.col("_n") == F.col("_t")).drop("_n", "_t")


def ssdeep_exact(probes: DataFrame, library: DataFrame) -> DataFrame:
    """Probes (value, size) that are an entry letter by letter (the dash form is not); the size rule holds."""
    entries = library.select(F.col("ssdeep").alias("value"), F.col("size").alias("sig_size"), F.col("name").alias("sig_name"))
    return probes.join(entries, "value").where(fits(F.col("sig_size"), F.col("size")))
