"""Digests, routing, sizes and time stamps as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length in hex digits of each digest.
DIGEST_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}


def digests(content: Column) -> dict[str, Column]:
    return {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256)}


def shard_hex(digest: Column) -> Column:
    """The first byte as two hex digits: 256 shards."""
    return F.substring(digest, 1, 2)


def shard_modulo(digest: Column, shards: int) -> Column:
    """The first four bytes, as one number, modulo the shards; four decimals."""
    return F.lpad((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % shards).cast("string"), 4, "0")


def hex_bytes(value: Column) -> Column:
    """Bytes of a field that is hex after trimming; null for anything else, and for nothing."""
    plain = F.lower(F.trim(value))
    return F.when(plain.rlike("^([0-9a-f]{2})+$"), F.unhex(plain))


def human_size(size: Column) -> Column:
    """``n B``, or one decimal of KB, MB or GB; exact ties go to the even digit."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        tenths = F.bround(size.cast("decimal(38,12)") / F.lit(1024**i).cast("decimal(20,0)"), 1)
        out = F.when(size >= 1024**i, F.concat(tenths.cast("decimal(38,1)").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def size_kb(size: Column) -> Column:
    """Whole KB below one MB, whole MB from there on."""
    return F.when(size < 1 << 20, F.concat(F.expr("0") + F.floor(size / 1024), F.lit("KB"))).otherwise(F.concat(F.floor(size / (1 << 20)), F.lit("MB")))


def pe_timestamp(seconds: Column) -> Column:
    """UTC time of a header's seconds; zero means none.  Years of more than four digits have no plus sign."""
    return F.when(seconds != 0, F.ltrim(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("+")))


def bloom_size(items: Column, rate: float = 0.01) -> tuple[Column, Column]:
    """(bits, hash functions) of a Bloom filter for so many items."""
    n = F.greatest(items, F.lit(1)).cast("double")
    m = F.ceil(-(n * math.log(rate)) / math.log(2) ** 2)
    return m, F.least(F.greatest(F.bround(m / n * math.log(2), 0).cast("int"), F.lit(1)), F.lit(16))


def fits(sig_size: Column, file_size: Column) -> Column:
    """A size matches when either is unknown or both are equal."""
    return sig_size.isNull() | file_size.isNull() | (sig_size == file_size)


def size_band(entry_size: Column, file_size: Column) -> Column:
    """Half to twice the probe's size; unknown sizes and empty probes match."""
    inside = entry_size.between(F.floor(file_size / 2), file_size * 2)
    return F.coalesce(file_size, F.lit(0)).__le__(0) | entry_size.isNull() | inside


def hash_kind(value: Column) -> Column:
    """Which store a hash goes to: sha256, md5 or invalid."""
    plain = F.lower(F.trim(value))
    return F.when(plain.rlike("^[0-9a-f]{64}$"), "sha256").when(plain.rlike("^[0-9a-f]{32}$"), "md5").otherwise("invalid")


def normal_fuzzy(kind: Column, value: Column) -> Column:
    """A fuzzy hash without blanks around it, in the form of its kind (ssdeep, tlsh, or hex digits in pairs); null if it has not that form."""
    plain = F.trim(value)
    ssdeep = F.when(plain.rlike(r"^[0-9]+[:|-][A-Za-z0-9+/]+[:|-][A-Za-z0-9+/]+$"), plain)
    tlsh = F.when(F.lower(plain).rlike("^(t[0-9a-f])?[0-9a-f]{70}$"), F.lower(plain))
    digits = F.when(plain.rlike("^([0-9A-Fa-f]{2})+$"), F.lower(plain))
    return F.when(kind == "ssdeep", ssdeep).when(kind == "tlsh", tlsh).otherwise(digits)


def valid_fuzzy(kind: Column, value: Column) -> Column:
    """Whether a value has the form of its kind of fuzzy hash (ssdeep or tlsh)."""
    return F.when(value.isNotNull(), normal_fuzzy(kind, value).isNotNull())
