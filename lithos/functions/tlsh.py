"""TLSH: locality-sensitive digests, their header fields and their distance.

A digest is 35 bytes (checksum, length code, quartile ratios, 32 body bytes),
written as 70 upper-case hex digits.  The triplet hash is Pearson's with a
permutation of the 256 byte values.  That permutation is a parameter: the
default is generated by a rule, so digests of this library compare with each
other; pass the published permutation to get digests that compare with those
of other programs.  Distances and header fields do not depend on it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_BYTES, MAX_BYTES = 50, 2 * 1024 * 1024
# Fixed values of the published scheme: distances of two quartile codes, and
# what differences of length and of quartile ratio are multiplied by.
CODE_DISTANCE = (
    (0, 1, 2, 6),
    (1, 0, 1, 2),
    (2, 1, 0, 1),
    (6, 2, 1, 0),
)
LENGTH_WEIGHT = RATIO_WEIGHT = 12
# Salts and window positions (0 is the newest byte) of the six triplets.
TRIPLETS = (
    (2, 0, 1, 2),
    (3, 0, 1, 3),
    (5, 0, 2, 3),
    (7, 0, 2, 4),
    (11, 0, 1, 4),
    (13, 0, 3, 4),
)
# Upper end of each range of lengths, its logarithm base, its offset.
LENGTH_CODES = (
    (656, 0.4054651, 0.0),
    (3199, 0.26236426, 8.72777),
    (math.inf, 0.095310180, 62.5472),
)


def permutation(seed: int = 1) -> bytes:
    """A permutation of the byte values by a fixed shuffle."""
    out, state = list(range(256)), seed
    for i in range(255, 0, -1):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        j = (state >> 33) % (i + 1)
        out[i], out[j] = out[j], out[i]
    return bytes(out)


def length_code(n: int) -> int:
    base, offset = next((b, o) for top, b, o in LENGTH_CODES if n <= top)
    return int(math.log(n) / base - offset) & 255


def _swap(x: int) -> int:
    return x >> 4 | (x & 15) << 4


def digest(data: bytes | None, table: bytes = permutation()) -> str | None:
    """The digest, or null for too short, too long or too uniform data."""
    if data is None or not MIN_BYTES <= len(data) <= MAX_BYTES:
        return None
    v = np.frombuffer(table, np.uint8)
    b = np.frombuffer(data, np.uint8)
    window = [b[4 - back : len(b) - back] for back in range(5)]
    buckets = np.zeros(256, np.int64)
    for salt, i, j, k in TRIPLETS:
        buckets += np.bincount(v[v[v[v[salt] ^ window[i]] ^ window[j]] ^ window[k]], minlength=256)
    used = buckets[:128]
    if np.count_nonzero(used) <= 64:
        return None
    checksum = 0
    for x in v[v[v[0] ^ window[0]] ^ window[1]].tolist():
        checksum = table[x ^ checksum]
    ranked = np.sort(used)
    q1, q2, q3 = (int(ranked[i]) for i in (31, 63, 95))
    codes = (used > q1).astype(int) + (used > q2) + (used > q3)
    body = (codes.reshape(32, 4) << np.array([0, 2, 4, 6])).sum(axis=1)[::-1]
    ratios = int(q1 * 100 / q3) % 16 | int(q2 * 100 / q3) % 16 << 4
    return bytes([_swap(checksum), _swap(length_code(len(data))), _swap(ratios), *body.tolist()]).hex().upper()


def digest_column(content: Column, table: bytes | None = None) -> Column:
    table = table or permutation()

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: digest(x, table))

    return run(content)


def normal(value: Column) -> Column:
    """Seventy upper-case hex digits without the ``T1`` prefix; null for anything else."""
    plain = F.regexp_replace(F.upper(value), "^T1", "")
    return F.when(plain.rlike("^[0-9A-F]{70}$"), plain)


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("int")


def header(tlsh: Column) -> dict[str, Column]:
    """Length code and both quartile ratios; nibbles are stored swapped."""
    at = lambda i: _number(F.substring(tlsh, i, 1))
    return {"lv": at(4) * 16 + at(3), "q1": at(5), "q2": at(6)}


def circular(a: Column, b: Column, size: int) -> Column:
    return F.least(F.abs(a - b), size - F.abs(a - b))


def reach(threshold: int) -> tuple[int, int]:
    """How far length codes and ratios may differ within a distance."""
    return max(1, threshold // LENGTH_WEIGHT), max(1, threshold // RATIO_WEIGHT + 1)


def wrapped_ranges(centre: int, d: int, top: int) -> list[tuple[int, int]]:
    """Closed ranges of the numbers 0..top within ``d`` of ``centre`` on the circle."""
    if d >= top:
        return [(0, top)]
    lo, hi = centre - d, centre + d
    if lo < 0:
        return [(0, hi), (top + 1 + lo, top)]
    return [(lo, hi)] if hi <= top else [(0, hi - top - 1), (lo, top)]


def _pairs() -> list[int]:
    """Distance of two hex digits (two quartile codes each), for all pairs in order."""
    return [CODE_DISTANCE[a & 3][b & 3] + CODE_DISTANCE[a >> 2][b >> 2] for a in range(16) for b in range(16)]


def distance(a: Column, b: Column) -> Column:
    """The distance of two normal digests; -1 if either is not one.  All in the JVM."""
    x, y = header(a), header(b)
    length = circular(x["lv"], y["lv"], 256)
    total = F.when(F.substring(a, 1, 2) != F.substring(b, 1, 2), 1).otherwise(0) + F.when(length <= 1, length).otherwise(length * LENGTH_WEIGHT)
    for q in ("q1", "q2"):
        d = circular(x[q], y[q], 16)
        total = total + F.when(d <= 1, d).otherwise((d - 1) * RATIO_WEIGHT)
    table = F.array(*map(F.lit, _pairs()))
    body = F.aggregate(F.sequence(F.lit(7), F.lit(70)), F.lit(0), lambda t, i: t + F.get(table, _number(F.substring(a, i, F.lit(1))) * 16 + _number(F.substring(b, i, F.lit(1)))))
    return F.coalesce(total + body, F.lit(-1))


_BYTES = None


def _byte_table() -> np.ndarray:
    global _BYTES
    if _BYTES is None:
        nibble = np.array(_pairs()).reshape(16, 16)
        x = np.arange(256)
        _BYTES = (nibble[x[:, None] >> 4, x >> 4] + nibble[x[:, None] & 15, x & 15]).astype(np.int32)
    return _BYTES


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of 35 bytes."""
    swap = lambda x: (x >> 4 | (x & 15) << 4).astype(np.int32)
    around = lambda x, y, n: np.minimum(np.abs(x - y), n - np.abs(x - y))
    d = around(swap(a[:, 1]), swap(b[:, 1]), 256)
    total = (a[:, 0] != b[:, 0]) + np.where(d <= 1, d, d * LENGTH_WEIGHT)
    x, y = swap(a[:, 2]), swap(b[:, 2])
    for p, q in ((x & 15, y & 15), (x >> 4, y >> 4)):
        d = around(p, q, 16)
        total = total + np.where(d <= 1, d, (d - 1) * RATIO_WEIGHT)
    return total + _byte_table()[a[:, 3:], b[:, 3:]].sum(axis=1)


@F.pandas_udf(T.IntegerType())
def fast_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """As :func:`distance`, a batch at a time."""
    rows = lambda s: np.frombuffer(bytes.fromhex("".join(s)), np.uint8).reshape(-1, 35)
    return pd.Series(distances(rows(a), rows(b)), dtype="int32") if len(a) else pd.Series([], dtype="int32")


#: So marked, a filter on the distance does not compute it once more.
fast_distance = fast_distance.asNondeterministic()


#: Pairs of digests that are compared together, probes among them.
_BLOCK, _PROBES = 1 << 18, 128
#: Dimensions that the codes are projected to where ``_MANY`` entries or more share them.
_KEPT, _MANY = 96, 512


def _planes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low bits of the 128 quartile codes of rows of 35 bytes, as two words each."""
    words = np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
    even = np.uint64(0x5555555555555555)
    high, low = words >> np.uint64(1) & even, words & even
    return tuple((x[:, :2] | x[:, 2:] << np.uint64(1)).T.copy() for x in (high, low))


def _part(high: np.ndarray, low: np.ndarray, same: np.ndarray, other_high: np.ndarray, other_low: np.ndarray) -> np.ndarray:
    """Distance of the 64 codes of a word: 1 where low bits differ, 2 where high ones do, 1 or 6 where both do."""
    x, y = high ^ other_high, low ^ other_low
    out = np.bitwise_count(y)
    y &= x
    x ^= y
    two = np.bitwise_count(x)
    two += two
    out += two
    y &= same  # codes 0 and 3, whose high and low bits are equal
    return out.astype(np.uint16) + 5 * np.bitwise_count(y).astype(np.uint16)


def _cost(x: np.ndarray, y: np.ndarray, n: int, free: int) -> np.ndarray:
    """What two length codes (``n`` 256, ``free`` 0) or ratios (16, 1) cost; both weigh the same."""
    d = np.abs(x - y)
    d = np.minimum(d, n - d)
    return np.where(d <= 1, d, (d - free) * LENGTH_WEIGHT)


def _plane(rows: np.ndarray) -> np.ndarray:
    """Each code as a point, (0, 0), (1, 0), (1, 1) or (2, 1): squared distances are those of codes, but 5 for 6."""
    codes = np.stack([rows[:, 3:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(rows), -1)
    return np.concatenate([codes + 1 >> 1, codes >> 1], axis=1).astype(np.float32)


def _projected(rows: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    if basis is None:
        return _plane(rows)
    return np.concatenate([_plane(rows[i : i + 8192]) @ basis for i in range(0, max(1, len(rows)), 8192)])


def _cells(rows: np.ndarray) -> np.ndarray:
    swapped = rows[:, 1:3] >> 4 | (rows[:, 1:3] & 15) << 4
    return np.stack([swapped[:, 0], swapped[:, 1] & 15, swapped[:, 1] >> 4], axis=1)


def nearest(probes: np.ndarray, entries: np.ndarray, threshold: int, k: int | None = None, before: np.ndarray | None = None, since: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, entry, distance) of rows of 35 bytes that differ and lie within the threshold: all, or the ``k`` least by (distance, entry's bytes).

    With ``before`` and ``since`` a probe meets only entries whose ``since`` is
    below its ``before``.  Pairs whose length codes and first ratios cost too much
    are never formed.  Of the others a product of matrices tells a bound: the
    points of the codes, projected to the directions in which entries differ
    most, are no farther apart than the codes.  What it leaves is compared in full.
    """
    some = entries[:: max(1, len(entries) // 4096)]
    basis = np.linalg.eigh(np.cov(_plane(some).T.astype(np.float64)))[1][:, -_KEPT:].astype(np.float32) if len(entries) >= _MANY else None
    cells, at = np.unique(_cells(entries), axis=0, return_inverse=True)
    order = np.lexsort([*entries.T[::-1], at.reshape(-1)])
    entries, cells = entries[order], cells[at.reshape(-1)[order]].astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], (cells[1:, :2] != cells[:-1, :2]).any(axis=1)])) if len(cells) else np.zeros(0, np.int64)
    sizes, leads = np.diff(lead, append=len(cells)), cells[lead]
    by_bytes = np.empty(len(entries), np.int64)
    by_bytes[np.lexsort(entries.T[::-1])] = np.arange(len(entries))
    high, low = _planes(entries)
    same = ~(high ^ low)
    p_high, p_low = _planes(probes)
    ratio = _cost(np.arange(16)[:, None], np.arange(16), 16, 1)
    points = _projected(entries, basis)
    points = np.concatenate([points, np.ones((len(points), 1)), (points**2).sum(axis=1, keepdims=True) / -2, np.eye(16)[cells[:, 2]]], axis=1, dtype=np.float32)
    probe_cells = _cells(probes).astype(np.int64)
    groups, probe_at = np.unique(probe_cells[:, :2], axis=0, return_inverse=True)
    probe_order = np.argsort(probe_at.reshape(-1), kind="stable")
    probe_ends = np.searchsorted(probe_at.reshape(-1)[probe_order], np.arange(len(groups) + 1))
    out = [(np.zeros(0, np.int64),) * 3]
    for c, (lv, q1) in enumerate(groups):
        base = _cost(leads[:, 0], lv, 256, 0) + _cost(leads[:, 1], q1, 16, 1)
        near = np.concatenate([[False], base <= threshold, [False]])
        edges = np.flatnonzero(near[1:] != near[:-1])
        starts = np.append(lead, len(entries))
        ranges = [(int(starts[i]), int(starts[j])) for i, j in zip(edges[::2], edges[1::2], strict=True)]
        if not ranges:
            continue
        base = np.repeat(base, sizes)
        least = ((base - threshold - 0.5) / 2).astype(np.float32)  # far more than what single precision loses
        mine = probe_order[probe_ends[c] : probe_ends[c + 1]]
        for i in range(0, len(mine), _PROBES):
            p, found = mine[i : i + _PROBES], []
            q = _projected(probes[p], basis)
            q = np.concatenate([q, (q**2).sum(axis=1, keepdims=True) / -2, np.ones((len(q), 1)), ratio[probe_cells[p, 2]] / -2], axis=1, dtype=np.float32)
            step = max(1, _BLOCK // len(p))
            for j, end in ((j, min(j + step, end)) for start, end in ranges for j in range(start, end, step)):
                x, y = np.divmod(np.flatnonzero(q @ points[j:end].T >= least[j:end]), end - j)
                if len(x):
                    x, y = p[x], y + j
                    d = base[y] + ratio[probe_cells[x, 2], cells[y, 2]] + (probes[x, 0] != entries[y, 0])
                    for w in range(2):
                        d = d + _part(high[w, y], low[w, y], same[w, y], p_high[w, x], p_low[w, x])
                    keep = (d <= threshold) & (d > 0)  # at no distance both are the same
                    if before is not None:
                        keep &= since[order[y]] < before[x]
                    found.append((x[keep], y[keep], d[keep].astype(np.int64)))
            if not found:
                continue
            x, y, d = (np.concatenate(z) for z in zip(*found, strict=True))
            if k is not None and len(x) > k:
                by = np.lexsort([by_bytes[y], d, x])
                x, y, d = x[by], y[by], d[by]
                first = np.searchsorted(x, x)  # of the same probe
                keep = np.arange(len(x)) - first < k
                x, y, d = x[keep], y[keep], d[keep]
            out.append((x, order[y], d))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))
