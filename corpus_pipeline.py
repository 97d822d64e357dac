"""A training-corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; all but
the last return the columns of ``documents``.  :func:`run` writes each stage's
result to the folder that the cluster shares, rereads it, and deletes the
tables that the stage made on its way and the result of the stage before.

For every stage: null text counts as empty, an empty table gives an empty
table, ids may be null or of any type, and columns beyond those that it reads
are carried along whatever their names.  Repeated rows, ties and the rest are
told with each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import op1_decontaminate, op3_mix, op5_lines, op6_jaccard, op9_quality
from lithos.llm.common import cut, delete, fold_of, fresh, load, row_key, scratch, shared_dir, small_batches, text_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    The network is fitted on labelled rows of ``docs`` (``labels`` by doc_id;
    crc32 of the id modulo 3 not 1).  A score of exactly 0.5 stays; null and
    empty texts are scored like any other; repeated rows are scored alike, so all
    stay or all go; without labels of both kinds every document has the share of
    good labels as its score.
    """
    small_batches(spark)
    net = op9_quality.fit(docs, load(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    score = fresh("_score", docs.columns)
    return op9_quality.score(docs, net, whole_rows=score).where(F.col(score) >= 0.5).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates go but for their first place; n_chars follows the text.

    No document goes: one whose every line recurs is left with an empty text.
    Null text stays null.  Repeated rows count as one document and get the same
    text; of equal lines the one of the least (id, text hash, line number) stays.
    Columns named n_lines and n_dropped keep their values.
    """
    small_batches(spark)
    names = docs.columns
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text"))
    out = op5_lines.dedup(rows)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {}
    return out.select(*[F.col("text") if c == "text" else length.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the least id, then text hash.

    Repeated rows and exact copies are of one group.  Of rows that share id and
    text the one with the least hash of all columns stays; null ids come before
    others.  Null, empty and wordless texts are of no group and all stay.  Rows
    that share id and text are merged before the shuffle, so that a key of many
    rows sends one row from each partition.
    """
    small_batches(spark)
    groups = cut(op6_jaccard.Join(docs).components(), "components")
    first = groups.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("id", "_k1", "_k2")).alias("k")).select("k._k1", "k._k2")
    worded = text_of().rlike(r"[^ \t\n\x0B\f\r]")
    one = docs.where(worded).select(F.struct("*").alias("_row"), *row_key(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_h")).groupBy("_k1", "_k2").agg(F.min_by("_row", "_h").alias("_row"))
    stay = one.join(first.hint("shuffle_hash"), ["_k1", "_k2"], "left_semi").select("_row.*")
    return stay.unionByName(docs.where(~worded))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, but for one edit in twenty characters, go.

    Null and empty items match nothing, equal items match alike, repeated rows
    all stay or all go; without items every document stays.
    """
    small_batches(spark)
    return op1_decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds block and slot: sources weigh the square root of their characters.

    Every row is placed once, repeated rows next to each other.  Null sources are
    one source.  Equal deadlines are served in the order of the sources' names.
    Columns named block and slot are replaced.
    """
    return op3_mix.mix(docs, block=op3_mix.BLOCK_CHARS, size=F.length("text"), temperature=0.5)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing sources", mix)]

#: A fitted network, connected components and schedules are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = load(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        if i:
            delete(spark, f"{top}/{i - 1}")
    return docs
