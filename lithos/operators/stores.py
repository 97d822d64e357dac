"""Signature stores as tables: ingest, conflicts, deletion, counts, layout, eviction.

A store is a DataFrame; every change is a new DataFrame.  Order of arrival is a
column (``seq``), never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.ctph import block_size, grams, normal, part
from lithos.functions.digests import DIGEST_LENGTHS, hex_bytes, shard_hex, shard_modulo


def wildcard_size(field: Column) -> Column:
    """``*`` and ``0`` match any size: null.  Unreadable sizes are null as well."""
    plain = F.trim(field)
    return F.when(~plain.isin("*", "0"), plain.try_cast("bigint"))


def parse_hdb(lines: DataFrame, algorithm: str = "sha256", line: str = "value") -> DataFrame:
    """(seq, hash, size, name, status) of every line ``hash:size:name`` that is not blank or a comment.

    ``status``: ok, skipped (a hash of another length), bad (no hex or too few
    fields) or size (the size is no number, where an import would stop).
    """
    rows = lines.withColumn("_l", F.trim(F.col(line))).where((F.col("_l") != "") & ~F.startswith(F.col("_l"), F.lit("#")))
    fields = F.split("_l", ":")
    digest = F.lower(F.trim(F.get(fields, F.lit(0))))
    size = F.trim(F.get(fields, F.lit(1)))
    length, wanted = F.length(digest), DIGEST_LENGTHS[algorithm]
    readable = size.isin("*", "0") | size.try_cast("bigint").isNotNull()
    status = (
        F.when(F.size(fields) < 3, "bad").when((length != wanted) & length.isin(*DIGEST_LENGTHS.values()), "skipped").when((length != wanted) | ~digest.rlike("^[0-9a-f]+$"), "bad").when(~readable, "size").otherwise("ok")
    )
    return rows.select("seq", digest.alias("hash"), wildcard_size(size).alias("size"), F.trim(F.get(fields, F.lit(2))).alias("name"), status.alias("status"))


#: The fuzzy hashes of an eight-field line and their places.
FUZZY_FIELDS = (("vhash", 4), ("authentihash", 5), ("imphash", 6), ("rich_header_hash", 7))


def parse_hdb8(lines: DataFrame, line: str = "value") -> DataFrame:
    """(seq, fuzzy_type, value, size, name, sha256): one row for each readable fuzzy hash of eight-field lines."""
    rows = lines.withColumn("_l", F.trim(F.col(line))).where((F.col("_l") != "") & ~F.startswith(F.col("_l"), F.lit("#")))
    f = F.split("_l", ":")
    sha = F.lower(F.trim(F.get(f, F.lit(0))))
    each = F.array(*[F.struct(F.lit(k).alias("fuzzy_type"), F.lower(F.hex(hex_bytes(F.get(f, F.lit(i))))).alias("value")) for k, i in FUZZY_FIELDS])
    out = rows.where((F.size(f) >= 8) & sha.rlike("^[0-9a-f]{64}$")).select("seq", F.explode(each).alias("x"), wildcard_size(F.get(f, F.lit(1))).alias("size"), F.trim(F.get(f, F.lit(2))).alias("name"), sha.alias("sha256"))
    return out.select("seq", "x.fuzzy_type", "x.value", "size", "name", "sha256").where("value IS NOT NULL")


def parse_ssdeep8(lines: DataFrame, line: str = "value") -> DataFrame:
    """(seq, ssdeep, size, name, sha256) of the fourth field of eight-field lines, in colon form."""
    rows = lines.withColumn("_l", F.trim(F.col(line))).where((F.col("_l") != "") & ~F.startswith(F.col("_l"), F.lit("#")))
    f = F.split("_l", ":")
    sha = F.lower(F.trim(F.get(f, F.lit(0))))
    return rows.where(F.size(f) >= 8).select("seq", normal(F.trim(F.get(f, F.lit(3)))).alias("ssdeep"), wildcard_size(F.get(f, F.lit(1))).alias("size"), F.trim(F.get(f, F.lit(2))).alias("name"), sha.alias("sha256")).where("ssdeep IS NOT NULL")


def first_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each key.  A partial minimum comes before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in rows.columns if c not in keys and c != seq]
    return rows.groupBy(*keys).agg(F.min(F.struct(seq, *rest)).alias("_f")).select(*keys, "_f.*")


def add(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with new rows whose key it does not have; the first of equal new keys."""
    fresh = first_wins(new, keys).join(store.select(*keys), keys, "left_anti")
    return store.unionByName(fresh.select(*store.columns))


def delete(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(gone.select(*keys).distinct(), keys, "left_anti")


def not_imported(files: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Files that the registry of imports does not name."""
    return files.join(registry.select(name), name, "left_anti")


def with_shard(store: DataFrame, layout: str = "hex", shards: int = 4, key: str = "hash") -> DataFrame:
    return store.withColumn("shard", shard_hex(F.col(key)) if layout == "hex" else shard_modulo(F.col(key), shards))


def counts(store: DataFrame, by: str) -> DataFrame:
    """Rows of each shard or type, and of all (null)."""
    return store.rollup(by).agg(F.count("*").alias("rows"))


def upsert(library: DataFrame, new: DataFrame, key: str, values: list[str], seq: str = "seq") -> DataFrame:
    """Existing keys keep their place and take the newest values; new keys come after, in order."""
    both = library.select(key, seq, *values).unionByName(new.select(key, seq, *values))
    return both.groupBy(key).agg(F.min(seq).alias(seq), F.max_by(F.struct(*values), seq).alias("_v")).select(key, seq, "_v.*")


def keep_newest(library: DataFrame, most: int, seq: str = "seq") -> DataFrame:
    """The ``most`` entries that came last.

    The cut-off is found with a bounded top-n, so no task sorts the library.
    """
    cut = library.select(seq).orderBy(F.desc(seq)).limit(most).agg(F.min(seq).alias("_cut"))
    return library.join(F.broadcast(cut), F.col(seq) >= F.col("_cut")).drop("_cut")  # one row


def gram_index(library: DataFrame, value: str = "ssdeep", entry: str = "seq") -> DataFrame:
    """(gram, blocksize, entry) of both parts of each entry."""
    both = F.array_union(grams(part(F.col(value), 1)), grams(part(F.col(value), 2)))
    return library.select(F.explode(both).alias("gram"), block_size(F.col(value)).alias("blocksize"), F.col(entry).alias("entry"))


def without_orphans(index: DataFrame, library: DataFrame, entry: str = "seq") -> DataFrame:
    """Index rows whose entry is still there."""
    return index.join(library.select(F.col(entry).alias("entry")), "entry", "left_semi")

