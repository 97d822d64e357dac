"""Media columns: FLAC streams as binary columns.

``encode`` writes 8-bit mono streams of fixed and linear predictors and Rice
residuals; ``decode`` reads any mono or stereo FLAC subset stream of constant,
verbatim, fixed and linear-prediction subframes and verifies every checksum;
``decode_many`` reads back streams of :func:`encode` many frames at a time;
``read_at`` reads some samples by the seek table.  Stored streams are read into
PCM blocks, one for each seek point, with the offset of their first sample.
Defined cases: null bytes give null, an empty payload an empty stream without
frames and no block, equal payloads equal streams; ids keep their type and other
columns are ignored; null text is empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

BLOCK = 192
#: Frames of one PCM block: from one seek point to the next.
SEEK_EVERY = 16
#: Order of the linear predictors, bits of a coefficient, and bits behind its point.
LPC, PRECISION, SHIFT = 6, 8, 6
#: Frames handled together; bounds the memory of the bit matrices.
CHUNK = 2048


def _table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, dtype=np.int32)


CRC8, CRC16 = _table(8, 0x07), _table(16, 0x8005)


def _crc(data: bytes, bits: int) -> int:
    table, crc = (CRC8 if bits == 8 else CRC16), 0
    for byte in data:
        crc = int(table[(crc >> (bits - 8)) ^ byte]) ^ (crc << 8 & ((1 << bits) - 1))
    return crc


def _crc_rows(rows: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC of the first ``lengths[i]`` bytes of each row."""
    table, crc, mask = (CRC8 if bits == 8 else CRC16), np.zeros(len(rows), np.int32), (1 << bits) - 1
    least = int(lengths.min(initial=0))
    columns = np.ascontiguousarray(rows.T)
    for j in range(int(lengths.max(initial=0))):
        new = table[(crc >> (bits - 8)) ^ columns[j]] ^ (crc << 8 & mask)
        crc = new if j < least else np.where(j < lengths, new, crc)
    return crc


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    count = next(c for c in range(2, 8) if n < 1 << (5 * c + 1))
    tail = [0x80 | n >> (6 * i) & 0x3F for i in range(count - 1)][::-1]
    return bytes([(0xFF << (8 - count) & 0xFF) | n >> (6 * (count - 1)), *tail])


def _header(number: int) -> bytes:
    head = b"\xff\xf8\x14\x02" + _utf8_number(number)  # fixed blocks of 192, 8 kHz, mono, 8 bits
    return head + bytes([_crc(head, 8)])


_HEADERS: list[bytes] = []


def _headers(most: int) -> list[bytes]:
    while len(_HEADERS) < most:
        _HEADERS.append(_header(len(_HEADERS)))
    return _HEADERS


def _rice(z: np.ndarray) -> np.ndarray:
    """The Rice parameter for each row of folded residuals."""
    return np.clip(np.floor(np.log2(np.maximum(z.mean(axis=1) * 0.69, 1))), 0, 14).astype(np.int32)


def _predictors(samples: np.ndarray) -> np.ndarray:
    """Linear prediction coefficients of each row (Levinson-Durbin), in steps of 2**-SHIFT."""
    x = samples.astype(np.float64)
    r = np.stack([(x[:, : BLOCK - k] * x[:, k:]).sum(axis=1) for k in range(LPC + 1)], axis=1)
    error, a = r[:, 0] * (1 + 1e-9) + 1e-3, np.zeros((len(x), LPC))
    for i in range(LPC):
        step = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - step[:, None] * a[:, :i][:, ::-1], step
        error = np.maximum(error * (1 - step * step), 1e-3)
    half = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -half, half - 1).astype(np.int32)


def _frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of ``samples`` (rows of BLOCK values of -128..127): bytes and lengths.

    Each takes the predictor of the fewest bits: fixed ones of order 0 to 4, or a linear one.
    """
    n, x = len(samples), samples.astype(np.int32)
    best_z, best, order, linear = np.zeros((n, BLOCK), np.int32), np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    weights = _predictors(samples)
    told = sum(weights[:, j : j + 1] * x[:, LPC - 1 - j : BLOCK - 1 - j] for j in range(LPC)) >> SHIFT
    for o, r, extra in [*((o, np.diff(x, n=o, axis=1) if o else x, 0) for o in range(5)), (LPC, x[:, LPC:] - told, 9 + PRECISION * LPC)]:
        z = (r << 1) ^ (r >> 31)
        k = _rice(z)
        cost = (z >> k[:, None]).sum(axis=1) + (BLOCK - o) * (1 + k) + 8 * o + extra
        better = cost < best
        best_z[better, o:], order[better], linear[better], best[better] = z[better], o, extra > 0, cost[better]
    counted = np.arange(BLOCK) >= order[:, None]
    k = np.zeros(n, np.int32)
    for o in np.unique(order):
        k[order == o] = _rice(best_z[order == o, o:])
    high = best_z >> k[:, None]
    length = np.where(counted, high + 1 + k[:, None], 0)
    heads = _headers(int(numbers.max()) + 1)
    head_len = np.array([len(heads[i]) for i in numbers])
    base = 8 * (head_len + 1 + order) + np.where(linear, 9 + PRECISION * LPC, 0) + 10
    ends = base[:, None] + np.cumsum(length, axis=1)
    bits_of = ends[:, -1]
    n_bytes = (bits_of + 7) // 8
    width = int(n_bytes.max()) + 2
    bits = np.zeros((n, width * 8), np.uint8)
    flat, row = bits.reshape(-1), (np.arange(n) * (width * 8))[:, None]
    one = row + ends - k[:, None] - 1  # where the unary part ends
    flat[one[counted]] = 1
    for b in range(int(k.max())):
        on = counted & (b < k[:, None]) & ((best_z >> np.maximum(k[:, None] - 1 - b, 0)) & 1).astype(bool)
        flat[(one + 1 + b)[on]] = 1
    for b in range(4):  # Rice method 0, one partition, parameter k
        flat[row[:, 0] + base - 4 + b] = k >> (3 - b) & 1
    at = np.flatnonzero(linear)
    if len(at):  # precision, shift, coefficients
        lead = np.array([int(c) for c in f"{PRECISION - 1:04b}{SHIFT:05b}"], np.uint8)
        each = np.unpackbits(weights[at].astype(np.int8).view(np.uint8).reshape(len(at), LPC), axis=1)
        both = np.concatenate([np.broadcast_to(lead, (len(at), 9)), each], axis=1)
        flat[(row[at, 0] + 8 * (head_len[at] + 1 + LPC))[:, None] + np.arange(both.shape[1])] = both
    out = np.packbits(bits, axis=1)
    for size in np.unique(head_len):
        at = np.flatnonzero(head_len == size)
        out[at, :size] = np.frombuffer(b"".join(heads[i] for i in numbers[at]), np.uint8).reshape(-1, size)
    rows = np.arange(n)
    out[rows, head_len] = np.where(linear, 0x20 | LPC - 1, 8 | order) << 1  # no wasted bits
    for o in range(1, int(order.max()) + 1):
        at = np.flatnonzero(order >= o)
        out[at, head_len[at] + o] = samples[at, o - 1].astype(np.int8).view(np.uint8)
    crc = _crc_rows(out, n_bytes, 16)
    out[rows, n_bytes], out[rows, n_bytes + 1] = crc >> 8, crc & 255
    return out, n_bytes + 2


def _meta(n: int, md5: bytes, least: int, most: int, points: list[tuple[int, int, int]]) -> bytes:
    info = struct.pack(">HH", BLOCK, BLOCK) + least.to_bytes(3, "big") + most.to_bytes(3, "big")
    info += (8000 << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + md5
    seek = b"".join(struct.pack(">QQH", *p) for p in points)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """One stream per payload; each payload is a multiple of BLOCK bytes of unsigned samples."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if any(len(p) % BLOCK for p in payloads):
        raise ValueError(f"payloads must be multiples of {BLOCK} bytes")
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    first = np.concatenate([[0], np.cumsum(counts)])
    numbers = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    body, lengths = [], []
    for i in range(0, len(samples), CHUNK):
        rows, n = _frames(samples[i : i + CHUNK], numbers[i : i + CHUNK])
        body.append(rows[np.arange(rows.shape[1]) < n[:, None]].tobytes())
        lengths.append(n)
    stream = b"".join(body)
    size = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        points = [(int(f - a) * BLOCK, int(at[f] - at[a]), BLOCK) for f in range(a, b, SEEK_EVERY)]
        md5 = hashlib.md5(samples[a:b].tobytes()).digest()
        least, most = (int(size[a:b].min()), int(size[a:b].max())) if b > a else (0, 0)
        out.append(_meta(int(b - a) * BLOCK, md5, least, most, points) + stream[at[a] : at[b]])
    return out


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


class FlacError(ValueError):
    """A stream that breaks the format or one of its checksums."""


def read_meta(data: bytes) -> dict:
    """STREAMINFO and SEEKTABLE, and where the first frame starts."""
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, last, out = 4, False, {"seek": []}
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + n]
        if len(block) < n:
            raise FlacError("metadata ends early")
        at += 4 + n
        if kind == 0:
            word = int.from_bytes(block[10:18], "big")
            out |= {"block": struct.unpack(">HH", block[:4]), "rate": word >> 44, "channels": (word >> 41 & 7) + 1, "bits": (word >> 36 & 31) + 1, "samples": word & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            out["seek"] = [struct.unpack(">QQH", block[i : i + 18]) for i in range(0, n, 18)]
    if "bits" not in out:
        raise FlacError("no STREAMINFO")
    return out | {"first": at}


class _Bits:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise FlacError("the stream ends early")
        a, b = self.at >> 3, (end + 7) >> 3
        self.at = end
        return (int.from_bytes(self.data[a:b], "big") >> (8 * b - end)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _subframe(bits: _Bits, n: int, depth: int) -> list[int]:
    head = bits.take(8)
    kind, wasted = head >> 1 & 63, 0
    if head & 1:
        wasted = bits.unary() + 1
        depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * n
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            weights, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
        else:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        method = bits.take(2)
        if method > 1:
            raise FlacError("unknown residual coding")
        wide, parts = (4, 5)[method], 1 << bits.take(4)
        for part in range(parts):
            count = n // parts - (order if not part else 0)
            k = bits.take(wide)
            raw = bits.take(5) if k == (1 << wide) - 1 else None
            for _ in range(count):
                if raw is None:
                    z = bits.unary() << k
                    z |= bits.take(k)
                    r = z >> 1 ^ -(z & 1)
                else:
                    r = bits.signed(raw)
                out.append(r + (sum(w * v for w, v in zip(weights, reversed(out[-order:]), strict=True)) >> shift if order else 0))
    else:
        raise FlacError("a reserved subframe type")
    return [v << wasted for v in out]


def frames(data: bytes, at: int | None = None, sample: int = 0) -> Iterator[tuple[int, list[list[int]]]]:
    """(first sample, samples by channel) of each frame; both checksums are verified.

    ``at`` is where a frame starts, ``sample`` its first sample.
    """
    meta = read_meta(data)
    at = meta["first"] if at is None else at
    while at < len(data):
        bits = _Bits(data, at)
        if bits.take(15) != 0x7FFC:
            raise FlacError("no frame starts here")
        bits.take(1)
        code, rate, channels, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        for _ in range(max(0, f"{lead:08b}".index("0") - 1) if lead < 255 else 6):
            bits.take(8)
        n = {0: 0, 1: 192, 6: -1, 7: -2}.get(code) or (576 << code - 2 if code < 6 else 256 << code - 8)
        n = bits.take(8) + 1 if n == -1 else bits.take(16) + 1 if n == -2 else n
        for _ in range({12: 1, 13: 2, 14: 2}.get(rate, 0)):
            bits.take(8)
        here = bits.at >> 3
        if bits.take(8) != _crc(data[at:here], 8):
            raise FlacError("the header checksum differs")
        depth = {0: meta["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth_code]
        side = {8: 1, 9: 0, 10: 1}.get(channels)
        found = [_subframe(bits, n, depth + (c == side)) for c in range(2 if channels >= 8 else channels + 1)]
        if channels == 8:
            found[1] = [a - b for a, b in zip(*found, strict=True)]
        elif channels == 9:
            found[0] = [a + b for a, b in zip(*found, strict=True)]
        elif channels == 10:
            both = [((m << 1 | s & 1) + s, (m << 1 | s & 1) - s) for m, s in zip(*found, strict=True)]
            found = [[v[0] >> 1 for v in both], [v[1] >> 1 for v in both]]
        end = (bits.at + 7) >> 3
        if data[end : end + 2] != _crc(data[at:end], 16).to_bytes(2, "big"):
            raise FlacError("the frame checksum differs")
        yield sample, found
        sample, at = sample + n, end + 2


def decode(data: bytes) -> bytes:
    """Interleaved signed little-endian PCM of a stream, its MD5 verified."""
    meta = read_meta(data)
    wide = (meta["bits"] + 7) // 8
    pcm = b"".join(v.to_bytes(wide, "little", signed=True) for _, block in frames(data) for row in zip(*block, strict=True) for v in row)
    if any(meta["md5"]) and hashlib.md5(pcm).digest() != meta["md5"]:
        raise FlacError("the audio checksum differs")
    return pcm


def _starts(data: np.ndarray, first: int) -> np.ndarray | None:
    """Where the frames of a stream of :func:`encode` start: sync code, header checksum and number."""
    if len(data) - first < 8:
        return np.zeros(0, np.int64) if len(data) == first else None
    raw, out = data.tobytes(), []
    want = _headers(1)[0]
    p = raw.find(want, first)
    while p >= 0:
        out.append(p)
        want = _headers(len(out) + 1)[len(out)]
        p = raw.find(want, p + len(want))
    return np.array(out, np.int64) if out and out[0] == first else None


def _read_frames(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> np.ndarray | None:
    """Samples of frames at buffer[start:end], all at the same step; None if a checksum or code is off."""
    n, longest = len(start), int((end - start).max())
    lo, hi = int(start[0]), int(end[-1])
    b = np.concatenate([buffer[lo:hi], np.zeros(longest + 8, np.uint8)])
    start, end = start - lo, end - lo
    rows = b[start[:, None] + np.arange(longest)]
    crc = _crc_rows(rows, end - start - 2, 16)
    if not np.array_equal(crc, b[end - 2].astype(np.int32) << 8 | b[end - 1]):
        return None
    kind = b[start + head].astype(np.int64)
    linear = kind >= 64
    order = np.where(linear, (kind >> 1) - 31, (kind >> 1) - 8)
    if ((kind & 1) | (order < 0) | (~linear & (order > 4))).any():
        return None
    wide = b.astype(np.int32)
    window = np.concatenate([wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:], np.zeros(3, np.int32)])

    def take(p: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return window[p >> 3] >> (24 - (p & 7) - size) & ((1 << size) - 1)

    p = 8 * (start + head + 1 + order)
    most = int(order[linear].max(initial=0))
    weights, shift = np.zeros((n, most), np.int32), np.zeros(n, np.int32)
    if most:
        precision = np.where(linear, take(p, 4) + 1, 0)
        shift = np.where(linear, take(p + 4, 5), 0)
        if (shift > 15).any() or (precision == 16).any():
            return None  # a negative shift or the reserved precision
        p = p + np.where(linear, 9, 0)
        for j in range(most):
            on = linear & (j < order)
            v = take(p, precision)
            weights[:, j] = np.where(on, v - (v >> np.maximum(precision - 1, 0) << precision), 0)
            p = p + np.where(on, precision, 0)
    if take(p, 6).any():
        return None
    k = take(p + 6, 4)
    if (k == 15).any():
        return None
    p = p + 10
    bits = np.unpackbits(b)
    before = np.cumsum(bits, dtype=np.int32)
    before -= bits
    ones = np.concatenate([np.flatnonzero(bits), np.full(8, len(bits) - 1)]).astype(np.int64)
    last = len(bits) - 32
    mask, drop = (1 << k) - 1, 24 - k
    z = np.zeros((BLOCK, n), np.int32)
    some = int(order.max())
    for j in range(BLOCK):
        one = ones[before[p]]
        tail = one + 1
        value = (one - p << k) | (window[tail >> 3] >> (drop - (tail & 7)) & mask)
        if j < some:
            on = j >= order
            z[j], p = np.where(on, value, 0), np.where(on, np.minimum(tail + k, last), p)
        else:
            z[j], p = value, np.minimum(tail + k, last)
    if not np.array_equal((p + 7) >> 3, end - 2):
        return None
    out = ((z >> 1) ^ -(z & 1)).T.copy()
    for o in range(1, some + 1):
        at_o = np.flatnonzero((order == o) & ~linear)
        if len(at_o):
            part = out[at_o, o:]
            warm = _warm(b, start, head, at_o, o)
            for level in range(o - 1, -1, -1):  # undo one difference at a time
                lead = np.diff(warm, n=level, axis=1)[:, :1] if level else warm[:, :1]
                part = np.cumsum(np.concatenate([lead, part], axis=1), axis=1)
            out[at_o] = part
        at_o = np.flatnonzero((order == o) & linear)
        if len(at_o):
            x, w, s = out[at_o].T.copy(), weights[at_o, :o].T[::-1].copy(), shift[at_o]
            x[:o] = _warm(b, start, head, at_o, o).T
            for i in range(o, BLOCK):
                x[i] += (w * x[i - o : i]).sum(axis=0) >> s
            out[at_o] = x.T
    return out


def _warm(b: np.ndarray, start: np.ndarray, head: np.ndarray, at: np.ndarray, o: int) -> np.ndarray:
    """The samples that a subframe of order ``o`` starts with."""
    return b[start[at, None] + head[at, None] + 1 + np.arange(o)].view(np.int8).astype(np.int32)


def decode_many(streams: list[bytes]) -> list[bytes]:
    """Signed 8-bit PCM of each stream; streams not of :func:`encode` go through :func:`decode`."""
    out: list[bytes | None] = [None] * len(streams)
    metas, found = [], []
    for i, s in enumerate(streams):
        meta = read_meta(s)
        at = _starts(np.frombuffer(s, np.uint8), meta["first"]) if meta["bits"] == 8 and meta["channels"] == 1 else None
        if at is None or len(at) * BLOCK != meta["samples"]:
            out[i] = decode(s)
        else:
            metas.append(meta)
            found.append((i, at))
    if found:
        buffer = np.frombuffer(b"".join(streams[i] for i, _ in found), np.uint8)
        sizes = np.array([len(streams[i]) for i, _ in found])
        shift = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        start = np.concatenate([at + s for (_, at), s in zip(found, shift, strict=True)])
        end = np.concatenate([np.append(at[1:], size) + s if len(at) else at for (_, at), s, size in zip(found, shift, sizes, strict=True)])
        number = np.concatenate([np.arange(len(at)) for _, at in found])
        head = np.array([len(h) for h in _headers(int(number.max(initial=0)) + 1)])[number] if len(number) else number
        parts = [_read_frames(buffer, start[a : a + CHUNK], end[a : a + CHUNK], head[a : a + CHUNK]) for a in range(0, len(start), CHUNK)]
        a = 0
        whole = None if any(p is None for p in parts) else np.concatenate([*parts, np.zeros((0, BLOCK), np.int32)]).astype(np.int8)
        for (i, at), meta in zip(found, metas, strict=True):
            pcm = None if whole is None else whole[a : a + len(at)].tobytes()
            a += len(at)
            out[i] = pcm if pcm is not None and hashlib.md5(pcm).digest() == meta["md5"] else decode(streams[i])
    return out  # type: ignore[return-value]


def _groups(values: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of ``values`` of about ``most`` bytes each; one value at least."""
    a = size = 0
    for i, v in enumerate(values):
        if i > a and size + len(v or b"") > most:
            yield a, i
            a, size = i, 0
        size += len(v or b"")
    if a < len(values):
        yield a, len(values)


def encode_column(df: DataFrame, column: str, out: str = "media") -> DataFrame:
    """Adds ``out``: the stream of the payload in ``column`` (binary); null stays null."""
    return _added(df, column, out, lambda v: encode_many(v))


def decode_column(df: DataFrame, column: str = "media", out: str = "pcm") -> DataFrame:
    """Adds ``out``: signed PCM of the stream in ``column``, read from its stored bytes; null stays null."""
    return _added(df, column, out, lambda v: decode_many(v))


def _added(df: DataFrame, column: str, out: str, of: Callable[[list], list], kind: str = "binary", arrow: pa.DataType = pa.binary()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for a, b in _groups(values):
                some = [v for v in values[a:b] if v is not None]
                made = iter(of(some) if some else [])
                got = pa.array([None if v is None else next(made) for v in values[a:b]], arrow)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, got], [*batch.schema.names, out])

    kept = df.drop(out)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` {kind}"]))


def read_at(data: bytes, first: int, count: int) -> bytes:
    """PCM of ``count`` samples from ``first`` on: frames before its seek point are not read."""
    meta = read_meta(data)
    wide = (meta["bits"] + 7) // 8
    sample, offset, _ = max((p for p in meta["seek"] if p[0] <= first), default=(0, 0, 0))
    out = []
    for at, block in frames(data, meta["first"] + offset, sample):
        if at >= first + count:
            break
        rows = list(zip(*block, strict=True))[max(0, first - at) : first + count - at]
        out += [v.to_bytes(wide, "little", signed=True) for row in rows for v in row]
    return b"".join(out)


BLOCKS = "array<struct<sample_offset:bigint,samples:int,pcm:binary>>"


def _blocks(data: bytes, pcm: bytes) -> list[dict]:
    """The PCM from each seek point to the next; a stream without a seek table is one block."""
    if not pcm:
        return []
    meta = read_meta(data)
    width = meta["channels"] * ((meta["bits"] + 7) // 8)
    starts = sorted({p[0] for p in meta["seek"]} | {0})
    return [{"sample_offset": a, "samples": (b or len(pcm) // width) - a, "pcm": pcm[a * width : b and b * width]} for a, b in zip(starts, [*starts[1:], None], strict=True)]


def blocks_column(df: DataFrame, column: str = "media", out: str = "blocks") -> DataFrame:
    """Adds ``out``: the PCM blocks of the stream in ``column``, read from its stored bytes; null stays null."""
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("samples", pa.int32()), ("pcm", pa.binary())]))
    return _added(df, column, out, lambda v: [_blocks(d, p) for d, p in zip(v, decode_many(v), strict=True)], BLOCKS, kind)


def pcm_blocks(df: DataFrame, id_col: str, column: str = "media") -> DataFrame:
    """Rows (id, sample_offset, samples, pcm): a block can be sought by its offset."""
    rows = blocks_column(df.select(F.col(id_col), F.col(column).alias(fresh("media", [id_col]))), fresh("media", [id_col]), fresh("blocks", [id_col]))
    return rows.select(F.col(id_col), F.explode(fresh("blocks", [id_col])).alias("b")).select(F.col(id_col), "b.*")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in bytes, and the bytes filled up with spaces to a positive multiple of BLOCK."""
    data = (text or "").encode()
    return len(data), data + b" " * (BLOCK * max(1, -(-len(data) // BLOCK)) - len(data))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text stored as a stream; every row gives one, null text counts as empty."""
    names = [id_col, "n_bytes", "media"]
    source = df.select(F.col(id_col), text_of(text_col).alias(fresh("text", [id_col])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            made = [payload_of(t) for t in texts.to_pylist()]
            for a, b in _groups([p for _, p in made]):
                media = encode_many([p for _, p in made[a:b]])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([n for n, _ in made[a:b]], pa.int64()), pa.array(media, pa.binary())], names)

    return source.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text of what its stored stream holds: sizes, digests, features of the samples.

    What is told of the samples comes from the PCM blocks that the stored column is read into.
    """
    rows = blocks_column(text_media(df, id_col, text_col))
    kinds = [("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("feature", "string", pa.string())]
    kept = [id_col, "n_bytes", "media_bytes", "media_sha256"]
    rows = rows.select(id_col, "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks in batch.column(4):
                signed = np.frombuffer(b"".join(x.as_py() for x in blocks.values.field("pcm")), np.int8)
                back = (signed.view(np.uint8) ^ 0x80).tobytes()
                wide = signed.astype(np.int32)
                turns = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
                feature = f"frames={len(signed) // BLOCK};min={wide.min()};max={wide.max()};sum={wide.sum()};energy={int((wide * wide).sum(dtype=np.int64))};turns={turns}"
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), feature))
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, (_, _, t) in zip(cols, kinds, strict=True))], [*kept, *(n for n, _, _ in kinds)])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"{n} {t}" for n, t, _ in kinds)]))
    return found.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
