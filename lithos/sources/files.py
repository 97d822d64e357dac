"""Sources and sinks: sample files, signature files, containers, rule folders, reports."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators.stores import first_wins

#: Larger samples keep digests and type but no static analysis.
INLINE_BYTES = 64 << 20
# Members of a signature container that are kept.
CONTAINER_MEMBERS = (".hdb", ".hsb", ".mdb", ".fp", ".ftm", ".ndb", ".ldb")


def samples(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, filename, size, content) of files, read through Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), "content")


def from_text(rows: DataFrame, key: str, text: str, filename: str | None = None) -> DataFrame:
    """Samples from a text column."""
    name = F.coalesce(F.col(filename), F.lit("unnamed")) if filename else F.lit("unnamed")
    return rows.select(F.col(key).alias("sample_id"), name.alias("filename"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("content"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, seq) of text files; ``seq`` orders all lines by file, then by place in it, however files are dealt to tasks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("_start"))
    # a block is read by one task in order, so the running number orders its lines
    return rows.select("file", "value", F.struct("file", "_start", F.monotonically_increasing_id().alias("line")).alias("seq"))


def generated(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``n`` synthetic signatures: digests of ``seed:i``."""
    i = F.col("id")
    return spark.range(n).select(F.sha2(F.concat(F.lit(f"{seed}:"), i), 256).alias("hash"), (100 + i % 900).alias("size"), F.format_string(f"Test.Gen.{seed}.%09d", i).alias("name"))


def container_header(data: bytes) -> dict | None:
    """Fields of a signature container's 512-byte header."""
    parts = data[:512].decode("latin-1").strip("\0 \n").split(":")
    if len(parts) < 5 or parts[0] != "ClamAV-VDB":
        return None
    return dict(zip(("magic", "time", "version", "signatures", "level", "md5"), parts, strict=False))


def container_members(files: DataFrame) -> DataFrame:
    """(name, member, content) of the kept members of containers (filename, content): a header, then a tar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if container_header(row["content"]) is None:
                    continue
                body = row["content"][512:]
                body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
                with tarfile.open(fileobj=io.BytesIO(body)) as tar:
                    out += [(row["filename"], m.name, tar.extractfile(m).read()) for m in tar if m.isfile() and m.name.lower().endswith(CONTAINER_MEMBERS)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.binary())], ["name", "member", "content"])

    return files.select("filename", "content").mapInArrow(run, "name string, member string, content binary")


def rule_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Rule files of a folder by path; rules are configuration, so they come to the driver."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.where(F.lower("path").rlike(r"\.yara?$") & ~F.contains("path", F.lit("/.git/")))
    return {r.path: bytes(r.content).decode("utf-8", "replace") for r in rows.select("path", "content").collect()}


def unsaved(new: DataFrame, saved: DataFrame, key: str = "sha256") -> DataFrame:
    """The samples to write to a content-addressed store: the first of each digest that it lacks."""
    return first_wins(new.withColumn("_s", F.monotonically_increasing_id()), [key], "_s").drop("_s").join(saved.select(key), key, "left_anti")


def write_store(store: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard, rows in order of the digest; a shard's rows meet in few files."""
    store.repartition(shard).sortWithinPartitions(shard, "hash").write.mode("overwrite").partitionBy(shard).parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)
