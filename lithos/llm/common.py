"""What the operators of this folder share: scratch tables, row keys, batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: texts may be long, so a batch holds few of them.
BATCH_ROWS = 512


#: Folders of local applications that name none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local master may do without it; a temporary folder serves there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lithos-")
    return _LOCAL[app]


#: The lists that open :func:`scratch` blocks keep of the tables written inside.
_OPEN: list[list[str]] = []


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there.

    The table stays until the enclosing :func:`scratch` block ends; without one
    it is the caller's to delete, since what is returned may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lithos-{name}-{uuid.uuid4().hex}"
    for made in _OPEN[-1:]:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table, wherever the cluster keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what :func:`cut` writes inside; results must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Has the driver drop shuffles and broadcasts of tables that are no more; else they stay until its heap is full."""
    gc.collect()  # Python's handles on the tables
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of a batch that goes to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns, never null, that tell rows apart.

    Rows that agree in id and text are the same document to every operator.
    """
    return [
        F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000")).alias("_k1"),
        F.xxhash64(text_of(text_col)).alias("_k2"),
    ]


#: Bits of the table of hashes that rows are sieved with.
SIEVE_BITS = 24


def sieve(rows: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """``rows`` rid of most that agree with no row of ``wanted`` in ``names``, before they are shuffled; none that agrees goes."""
    bucket = F.pmod(F.xxhash64(*names), F.lit(1 << SIEVE_BITS))
    words = wanted.select(bucket.alias("b")).groupBy(F.shiftright("b", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("x"))
    every = wanted.sparkSession.range(1 << SIEVE_BITS - 6).join(words, "id", "left").select(F.struct("id", F.coalesce("x", F.lit(0).cast("long")).alias("x")).alias("s"))
    bits = cut(every.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]).alias("_bits")), "sieve")  # one row of 2 MB
    kept = rows.withColumn("_b", bucket).crossJoin(F.broadcast(bits))
    return kept.where(F.expr("(shiftright(_bits[cast(shiftright(_b, 6) AS int)], cast(_b & 63 AS int)) & 1) = 1")).drop("_b", "_bits")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as set it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
