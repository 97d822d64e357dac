"""Context-triggered piecewise hashes (ssdeep form): digests, forms, grams and scores.

From the published description of the algorithm (spamsum): a rolling hash over
seven bytes cuts the data where it meets the block size; each piece adds one
base64 character of an FNV hash; a second hash uses twice the block size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_BYTES, MAX_BYTES = 32, 2 * 1024 * 1024
# Fixed values of the published scheme.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LONGEST, LEAST_BLOCK = 7, 64, 3
FNV_START, FNV_PRIME = 0x28021967, 0x01000193


def rolling(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: sum, weighted sum and shifted xor of the last seven."""
    b = np.concatenate([np.zeros(WINDOW, np.uint32), np.frombuffer(data, np.uint8).astype(np.uint32)])
    n = len(data)
    last = [b[WINDOW - i : WINDOW - i + n] for i in range(WINDOW)]  # newest first
    plain = sum(last)
    weighted = sum((WINDOW - i) * x for i, x in enumerate(last))
    shifted = np.zeros(n, np.uint32)
    for i, x in enumerate(last):
        shifted ^= x << np.uint32(5 * i) & np.uint32(0xFFFFFFFF)
    return plain + weighted + shifted


def _pieces(data: bytes, roll: np.ndarray, block: int, longest: int) -> str:
    """One character for each piece; what is beyond the longest length joins the last one."""
    cuts = (np.flatnonzero(roll % np.uint32(block) == block - 1) + 1).tolist()[: longest - 1]
    out, start = [], 0
    for end in [*cuts, len(data)]:
        h = FNV_START & 63  # the character is the low six bits, and they depend on no others
        for x in data[start:end]:
            h = (h * FNV_PRIME ^ x) & 63
        if end != len(data) or (start < end and roll[-1]) or end in cuts:
            out.append(ALPHABET[h])
        start = end
    return "".join(out)


def digest(data: bytes | None) -> str | None:
    """``block:first:second``, or null for data outside 32 bytes to 2 MB."""
    if data is None or not MIN_BYTES <= len(data) <= MAX_BYTES:
        return None
    block = LEAST_BLOCK
    while block * LONGEST < len(data):
        block *= 2
    roll = rolling(data)
    while True:
        first = _pieces(data, roll, block, LONGEST)
        if block <= LEAST_BLOCK or len(first) >= LONGEST // 2:
            break
        block //= 2
    out = f"{block}:{first}:{_pieces(data, roll, block * 2, LONGEST // 2)}"
    return None if out == "3::" else out


@F.pandas_udf(T.StringType())
def digest_column(content: pd.Series) -> pd.Series:
    return content.map(digest)


def normal(value: Column) -> Column:
    """Colon form of a digest in colon or dash form: its first three parts; null if the block is no number."""
    parts = F.when(F.contains(value, F.lit(":")), F.split(value, ":")).otherwise(F.split(value, "-"))
    return F.when((F.size(parts) >= 3) & F.get(parts, F.lit(0)).rlike("^[0-9]+$"), F.concat_ws(":", F.slice(parts, 1, 3)))


def block_size(value: Column) -> Column:
    """The number before the first colon; 0 if there is none."""
    return F.coalesce(F.substring_index(value, ":", 1).try_cast("bigint"), F.lit(0))


def part(value: Column, i: int) -> Column:
    return F.get(F.split(value, ":"), F.lit(i))


def strip_runs(value: Column) -> Column:
    """Runs of more than three equal characters cut to three."""
    return F.regexp_replace(value, r"(.)\1{3,}", "$1$1$1")


def grams(value: Column) -> Column:
    """Distinct 7-grams of a stripped hash; none if it is short or not base64."""
    s = strip_runs(value)
    return F.when((F.length(s) >= WINDOW) & s.rlike("^[A-Za-z0-9+/]+$"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - WINDOW + 1), lambda i: F.substring(s, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<string>"))


def gram_code(gram: Column) -> Column:
    """A 7-gram as one number, six bits a character."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WINDOW)), F.lit(0).cast("bigint"), lambda t, i: t * 64 + F.instr(F.lit(ALPHABET), F.substring(gram, i, F.lit(1))) - 1)


def _strip(s: str) -> str:
    out = []
    for c in s:
        if len(out) < 3 or not out[-1] == out[-2] == out[-3] == c:
            out.append(c)
    return "".join(out)


def _edit(a: str, b: str) -> int:
    """Insertions and deletions cost one, substitutions two: what the longest common subsequence leaves over.

    One number holds a row of that subsequence's table, a bit for each letter of ``a``.
    """
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        same = row & at.get(y, 0)
        row = (row + same | row - same) & whole
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def _similar(a: str, b: str, block: int) -> int:
    if len(a) > LONGEST or len(b) > LONGEST or not {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)} & {b[i : i + WINDOW] for i in range(len(b) - WINDOW + 1)}:
        return 0
    score = 100 - 100 * (_edit(a, b) * LONGEST // (len(a) + len(b))) // LONGEST
    return min(score, block // LEAST_BLOCK * min(len(a), len(b)))


def compare(a: str | None, b: str | None) -> int:
    """0 to 100; 0 when the block sizes do not fit or no seven characters in a row are shared."""
    if not a or not b:
        return 0
    (n, a1, a2), (m, b1, b2) = (x.split(":")[:3] for x in (a, b))
    n, m = int(n), int(m)
    a1, a2, b1, b2 = map(_strip, (a1, a2, b1, b2))
    if n == m:
        if a1 == b1 and a2 == b2 and len(a1) >= WINDOW:
            return 100
        return max(_similar(a1, b1, n), _similar(a2, b2, n * 2))
    if n == m * 2:
        return _similar(a1, b2, n)
    if m == n * 2:
        return _similar(a2, b1, m)
    return 0


@F.pandas_udf(T.IntegerType())
def score_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([compare(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


#: So marked, a filter on the score does not compute it once more.
score_column = score_column.asNondeterministic()
