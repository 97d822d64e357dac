"""Bloom filters as columns, for stores that are probed from outside Spark.

Inside Spark, joins need none: the planner adds its own where they help.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parameters(items: int, rate: float = 0.01) -> tuple[int, int]:
    n = max(1, items)
    bits = math.ceil(-(n * math.log(rate)) / math.log(2) ** 2)
    return bits, max(1, min(16, round(bits / n * math.log(2))))


def positions(digest: bytes, bits: int, hashes: int) -> list[int]:
    """Two 32-bit halves of an eight-byte BLAKE2b digest, the second one odd, step through the bits."""
    a, b = struct.unpack("<II", hashlib.blake2b(digest, digest_size=8).digest())
    return [(a + i * (b | 1)) % bits for i in range(hashes)]


def build(rows: DataFrame, key: str, shard: str, rate: float = 0.01) -> DataFrame:
    """(shard, items, bits): a filter of the hex digests of each shard, sized by what the shard holds.

    Every task sends its own filter of a shard, a bitmap, and those are joined.
    """
    keyed = rows.select(F.col(shard).cast("string").alias("shard"), F.col(key).alias("key")).where(F.col("key").isNotNull() & F.col("shard").isNotNull())
    sized = keyed.join(F.broadcast(keyed.groupBy("shard").agg(F.count("*").alias("items"))), "shard")  # shards are few: digits of the digest

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for s, digest, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits, hashes = parameters(items, rate)
                if s not in own:
                    own[s] = items, np.zeros((bits + 7) // 8, np.uint8)
                at = np.array(positions(bytes.fromhex(digest), bits, hashes))
                np.bitwise_or.at(own[s][1], at >> 3, (1 << (at & 7)).astype(np.uint8))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([n for n, _ in own.values()], pa.int64()), pa.array([x.tobytes() for _, x in own.values()], pa.binary())], ["shard", "items", "bits"])

    def join(table: pa.Table) -> pa.Table:
        out = np.frombuffer(table["bits"][0].as_py(), np.uint8).copy()
        for x in table["bits"][1:]:
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"shard": table["shard"][:1], "items": table["items"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    schema = "shard string, items bigint, bits binary"
    return sized.select("shard", "key", "items").mapInArrow(local, schema).groupBy("shard").applyInArrow(join, schema)


def holds(filter_bits: bytes, digest: bytes, items: int, rate: float = 0.01) -> bool:
    return all(filter_bits[p >> 3] >> (p & 7) & 1 for p in positions(digest, *parameters(items, rate)))
