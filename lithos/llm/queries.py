"""The registered queries of the ten operators, and their SQL where it can be told in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_decontaminate, op2_secrets, op3_mix, op4_langid, op5_lines, op6_jaccard, op7_pii, op8_flac, op9_quality, op10_ctw
from .common import fold_of, load, small_batches
from .sql import SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return load(spark, sf_dir, "documents")


def op1_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_decontaminate.contamination(_documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


def op2_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the corpus: half of the rows, then all of them; the ledger tells the second what is new."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    history = op2_secrets.scan_history([docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), docs])
    rows = op2_secrets.by_path(docs, None, known=history.known)
    base = [r.name for r in op2_secrets.BASE]
    of = lambda *kinds: F.filter("findings", lambda f: f["rule"].isin(*kinds))
    named = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ",")
    return rows.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(named(of(*base)), 256).alias("base_sha256"), named(F.col("findings")).alias("spans"))


def op3_mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh the square root of their characters: where each document stands in the mixture."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    mixed = op3_mix.mix(docs, block=op3_mix.BLOCK_CHARS, size=F.length("text"), temperature=0.5)
    return mixed.select("doc_id", "source", "block", "slot")


def op4_langid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = fold_of("doc_id", 4) == 2
    model = op4_langid.fit(docs, ~held)
    return op4_langid.predict(docs, model, keep=(held.alias("held_out"),))


def op5_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lines.dedup(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op6_jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_jaccard.Join(_documents(spark, sf_dir)).components().select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def _private(rows: DataFrame) -> DataFrame:
    named = lambda kind, spans: F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))
    base = F.concat(*[named(k, k) for k in op7_pii.KINDS])
    spans = F.concat(base, named(op7_pii.TERM, "terms"))
    return rows.select(F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in op7_pii.KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"))


def op7_pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _private(op7_pii.detect(_documents(spark, sf_dir).select("doc_id", "text")))


def op8_flac_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_flac.media_digests(_documents(spark, sf_dir))


def op9_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), load(spark, sf_dir, "labels")
    held = fold_of("doc_id", 3) == 1
    net = op9_quality.fit(docs, labels, ~held)
    return op9_quality.score(docs, net, keep=(held.alias("held_out"),)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_ctw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = fold_of("doc_id", 10) == 0
    model = op10_ctw.fit(docs.where(~held).select(op10_ctw.text_of("text").alias("text")))
    return op10_ctw.score(docs, model, keep=(held.alias("held_out"),))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate_query,
        "op2_secrets": op2_secrets_query,
        "op3_mix": op3_mix_query,
        "op4_langid": op4_langid_query,
        "op5_lines": op5_lines_query,
        "op6_jaccard": op6_jaccard_query,
        "op7_pii": op7_pii_query,
        "op8_flac": op8_flac_query,
        "op9_quality": op9_quality_query,
        "op10_ctw": op10_ctw_query,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
