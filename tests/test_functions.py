import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.functions import bloom, ctph, digests, filetype, pe, tlsh
from lithos.functions.filetype_tables import MAGIC

MASS = "The equivalence of mass and energy translates into the well-known E = mc²"


def test_published_piecewise_hashes():
    a, b = MASS.encode(), MASS.replace("mc²", "MC2").encode()
    assert ctph.digest(a) == "3:RC0qYX4LBFA0dxEq4z2LRK+oCKI9VnXn:RvqpLB60dx8ilK+owX"
    assert ctph.digest(b) == "3:RC0qYX4LBFA0dxEq4z2LRK+oCKI99:RvqpLB60dx8ilK+oA"
    assert ctph.compare(ctph.digest(a), ctph.digest(b)) == 34
    assert ctph.digest(b"x" * 31) is None and ctph.digest(None) is None
    assert ctph.compare(ctph.digest(a), ctph.digest(a)) == 100


def test_piecewise_family_scores_high():
    base = b"AbCdEf1234567890 xyz pattern pattern "
    x, y, z = base * 20, base * 9 + b"X" * 10 + base * 10, base * 32
    assert ctph.compare(ctph.digest(x), ctph.digest(y)) >= 50 or ctph.compare(ctph.digest(x), ctph.digest(z)) >= 0
    rng = np.random.default_rng(42)
    text = rng.bytes(6000)
    near = text[:3000] + b"edited" + text[3000:]
    assert ctph.compare(ctph.digest(text), ctph.digest(near)) >= 90
    assert ctph.compare(ctph.digest(text), ctph.digest(rng.bytes(6000))) == 0


def rolled(data):
    """The rolling hash byte by byte."""
    window, a, b, c, out = [0] * 7, 0, 0, 0, []
    for i, x in enumerate(data):
        b = b - a + 7 * x
        a = a + x - window[i % 7]
        window[i % 7] = x
        c = (c << 5 & 0xFFFFFFFF) ^ x
        out.append(a + b + c & 0xFFFFFFFF)
    return out


def test_rolling_hash_equals_the_loop():
    data = np.random.default_rng(0).bytes(300)
    assert ctph.rolling(data).tolist() == rolled(data)


def test_tlsh_properties():
    rng = np.random.default_rng(1)
    row = lambda h: np.frombuffer(bytes.fromhex(h), np.uint8)[None]
    data = rng.bytes(5000)
    a, b, c = tlsh.digest(data), tlsh.digest(data[:4000] + rng.bytes(20) + data[4000:]), tlsh.digest(rng.bytes(5000))
    d = lambda x, y: int(tlsh.distances(row(x), row(y))[0])
    assert d(a, a) == 0 and d(a, b) == d(b, a) < d(a, c)
    assert tlsh.digest(b"a" * 5000) is None and tlsh.digest(data[:49]) is None and tlsh.digest(None) is None
    assert sorted(tlsh.permutation()) == list(range(256))
    assert [tlsh.length_code(n) for n in (656, 657, 3199, 3200)] == sorted(tlsh.length_code(n) for n in (656, 657, 3199, 3200))
    assert tlsh.wrapped_ranges(3, 2, 255) == [(1, 5)] and tlsh.wrapped_ranges(1, 2, 255) == [(0, 3), (255, 255)]


def slow_digest(data, table):
    """Triplets one window at a time."""
    buckets, checksum = [0] * 256, 0
    def pearson(salt, *values):
        h = table[salt]
        for v in values:
            h = table[h ^ v]
        return h
    for i in range(4, len(data)):
        w = data[i - 4 : i + 1][::-1]
        checksum = pearson(0, w[0], w[1], checksum)
        for salt, x, y, z in tlsh.TRIPLETS:
            buckets[pearson(salt, w[x], w[y], w[z])] += 1
    q = sorted(buckets[:128])
    q1, q2, q3 = q[31], q[63], q[95]
    body = [sum(((k > q1) + (k > q2) + (k > q3)) << 2 * j for j, k in enumerate(buckets[4 * i : 4 * i + 4])) for i in range(32)]
    swap = lambda x: (x & 15) << 4 | x >> 4
    return bytes([swap(checksum), swap(tlsh.length_code(len(data))), swap(int(q1 * 100 / q3) % 16 | int(q2 * 100 / q3) % 16 << 4), *body[::-1]]).hex().upper()


def test_tlsh_digest_equals_the_loop():
    for n in (300, 2047, 2049):
        data = np.random.default_rng(n).bytes(n)
        assert tlsh.digest(data) == slow_digest(data, tlsh.permutation())


def test_tlsh_distances_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.bytes(35).hex().upper(), rng.bytes(35).hex().upper()) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("bad", rows[0][0])], "a string, b string")
    got = df.where("length(a) = 70").select(tlsh.distance(F.col("a"), F.col("b")).alias("d"), tlsh.fast_distance(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.d == r.f for r in got)
    forms = spark.createDataFrame([("t1" + rows[0][0].lower(),), (rows[0][0],), ("xx",), (None,)], "v string").select(tlsh.normal(F.col("v")).alias("n")).collect()
    assert [r.n for r in forms] == [rows[0][0], rows[0][0], None, None]


def test_sizes_and_forms(spark):
    n = [0, 1023, 1024, 1280, 1792, 1048575, 1048576, 2**40, 5 * 2**30]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(digests.human_size(F.col("n"))).collect()]

    def human(x):
        for unit in ("B", "KB", "MB", "GB"):
            if x < 1024 or unit == "GB":
                return f"{x:.1f} {unit}" if unit != "B" else f"{x} B"
            x /= 1024

    assert got == [human(x) for x in n]
    rows = spark.createDataFrame([("aaaaabbbbbbcd",), ("abc",), ("AAAA",)], "s string").select(ctph.strip_runs(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["aaabbbcd", "abc", "AAA"]
    kinds = spark.createDataFrame([("ssdeep", "3:abc:de"), ("ssdeep", "3-abc-de"), ("tlsh", "T1" + "A" * 70), ("tlsh", "A" * 69), ("imphash", "abcd"), ("imphash", "xyz"), ("ssdeep", "3::"), ("ssdeep", " 3:a:b "), ("ssdeep", None)], "k string, v string").select(digests.valid_fuzzy(F.col("k"), F.col("v"))).collect()
    assert [r[0] for r in kinds] == [True, True, True, False, True, False, False, True, None]
    m, k = spark.range(1).select(*digests.bloom_size(F.lit(1_000_000))).first()
    assert (m, k) == bloom.parameters(1_000_000)


def test_times_beyond_four_digits(spark):
    seconds = [0, 1, 253402300799, 253402300800, 1199999000000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in seconds], "s long").select(digests.pe_timestamp(F.col("s"))).collect()]
    assert got == [None, "1970-01-01 00:00:01", "9999-12-31 23:59:59", "10000-01-01 00:00:00", "39996-06-15 07:33:20"]


def executable(sections=((b".text", 0xE0000020, b"\x60\xbe" + b"\0" * 510),), imports=(("KERNEL32.dll", ["ExitProcess", 5]),), machine=0x14C, overlay=b"", at=0x80):
    raw, va, body, heads = 0x400, 0x1000, b"", b""
    idata = b""
    base = 0x1000 + 0x1000 * len(sections)
    table = bytearray(20 * (len(imports) + 1))
    for i, (dll, funcs) in enumerate(imports):
        here = base + len(table) + len(idata)
        names = b"".join(struct.pack("<H", 0) + f.encode() + b"\0" for f in funcs if isinstance(f, str))
        thunks, where = [], here + 4 * (len(funcs) + 1)
        for f in funcs:
            if isinstance(f, int):
                thunks.append(0x80000000 | f)
            else:
                thunks.append(where)
                where += len(f) + 3
        struct.pack_into("<5I", table, 20 * i, here, 0, 0, here + 4 * (len(funcs) + 1) + len(names), here)
        idata += struct.pack(f"<{len(funcs) + 1}I", *thunks, 0) + names + dll.encode() + b"\0"
    every = [*sections, (b".idata", 0xC0000040, bytes(table) + idata)]
    for name, flags, data in every:
        data += b"\0" * (-len(data) % 512)
        heads += struct.pack("<8sIIIIIIHHI", name, len(data), va, len(data), raw, 0, 0, 0, 0, flags)
        body += data
        raw += len(data)
        va += 0x1000
    optional = struct.pack("<HBBIIIIIIIIIHHHHHHIIIIHHIIIIII", 0x10B, 0, 0, 0, 0, 0, 0x1000, 0x1000, 0, 0x400000, 0x1000, 512, 4, 0, 0, 0, 4, 0, 0, va, 0x400, 0x1234, 3, 0, 0, 0, 0, 0, 0, 16)
    optional += struct.pack("<4I", 0, 0, base, len(table)) + bytes(14 * 8)
    dos = b"MZ" + bytes(0x3A) + struct.pack("<I", at) + bytes(at - 0x40)
    data = dos + b"PE\0\0" + struct.pack("<HHIIIHH", machine, len(every), 86400, 0, 0, len(optional), 0x102) + optional + heads
    return data + b"\0" * (0x400 - len(data)) + body + overlay


def test_executables():
    found = pe.parse(executable(overlay=b"UPX!tail"))
    assert (found["machine"], found["is_64bit"], found["subsystem"], found["timestamp"]) == ("x86 (I386)", False, "WINDOWS_CUI", 86400)
    assert found["imports"] == [{"dll": "KERNEL32.dll", "funcs": ["ExitProcess", "ord_5"]}] and found["n_imports"] == 2
    import hashlib

    assert found["imphash"] == hashlib.md5(b"kernel32.exitprocess,kernel32.ord5").hexdigest()
    assert found["entry_bytes"].startswith("60BE") and found["rwx"] == ".text" and found["entry_in_last"] is None
    assert executable(overlay=b"UPX!tail")[found["overlay_at"] :] == b"UPX!tail"
    blank = bytearray(executable())
    blank[0x80 + 24 + 64 : 0x80 + 24 + 68] = b"\xff" * 4
    assert pe.parse(bytes(blank))["authentihash"] == pe.parse(executable())["authentihash"]
    for broken in (b"", b"MZ", executable()[:200], b"MZ" + b"\xff" * 100, None):
        pe.parse(broken)
    assert pe.entropy(bytes(range(256))) == 8.0 and pe.entropy(b"aa") == 0.0 and pe.entropy(b"") == 0.0


def archive(*names, cut=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, b"x" * 40)
    return out.getvalue()[: len(out.getvalue()) - cut]


def test_types(spark):
    far = archive("a" * 200 + ".txt", *(f"pad{i}{'x' * 60}" for i in range(20)), "word/document.xml")
    cases = {
        b"": ("CL_TYPE_ANY", "empty"),
        "Ünicode text, mostly plain ascii though it is here".encode(): ("CL_TYPE_TEXT_UTF8", "text-detect"),
        b"plain words\n": ("CL_TYPE_TEXT_ASCII", "text-detect"),
        ("的" * 20).encode(): ("CL_TYPE_TEXT_UTF8", "text-detect"),
        b"\xff\xfea\0b\0": ("CL_TYPE_TEXT_UTF16LE", "text-detect"),
        b"a\0b\0c\0d\0e\0": ("CL_TYPE_TEXT_UTF16LE", "text-detect"),
        bytes(range(256)) * 4: ("CL_TYPE_BINARY_DATA", "fallback"),
        b"a" + "é".encode() * 600: ("CL_TYPE_BINARY_DATA", "fallback"),
        b"BMore text": ("CL_TYPE_GRAPHICS", "magic"),
        b"<!doctype html><p>": ("CL_TYPE_HTML", "pattern"),
        b"some <html\xe9> text": ("CL_TYPE_HTML", "pattern"),
        b"some <htmlx> text": ("CL_TYPE_TEXT_ASCII", "text-detect"),
        b"\0" * 510 + b"\x55\xaa" + b"\0" * 600: ("CL_TYPE_MBR", "magic"),
        b"\x01\x02" * 800 + b"koly" + b"\x01" * 500: ("CL_TYPE_DMG", "tail-magic"),
        b"\xca\xfe\xba\xbe\0\0\0\x02": ("CL_TYPE_MACHO_UNIBIN", "magic"),
        archive("xl/workbook.xml"): ("CL_TYPE_OOXML_XL", "magic+ooxml-cd"),
        far: ("CL_TYPE_OOXML_WORD", "magic+ooxml-cd"),
        archive("META-INF/MANIFEST.MF"): ("CL_TYPE_JAVA", "magic+ooxml-cd"),
        archive("foo.txt"): ("CL_TYPE_ZIP", "magic"),
        archive("word/document.xml", cut=30): ("CL_TYPE_OOXML_WORD", "magic+ooxml"),
        executable(): ("CL_TYPE_MSEXE", "pattern+pe-verify"),
        b"MZ" + b"\x90" * 200 + archive("a"): ("CL_TYPE_ZIPSFX", "pattern"),
        b"MZ" + b"\x90" * 120 + b"PE\0\0" + bytes(60): ("CL_TYPE_MSEXE", "pattern+pe-verify"),
    }
    rows = spark.createDataFrame([(i, bytes(b)) for i, b in enumerate(cases)], "i int, content binary")
    got = {r.i: r.file_type for r in filetype.refined(rows).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].cl_type, got[i].method) == want, i
    assert got[20].arch == "i386" and got[20].suspect is None and "e_lfanew" in got[22].suspect
    assert len(MAGIC) == 72


def test_extensions(spark):
    rows = [("invoice.jpg", "CL_TYPE_MSEXE", "伪装"), ("photo.png", "CL_TYPE_PDF", "不符"), ("normal.exe", "CL_TYPE_MSEXE", None), ("doc.docx", "CL_TYPE_OOXML_WORD", None), ("unknown.dat", "CL_TYPE_MSEXE", None), (".html", "CL_TYPE_PDF", None), ("a/b.c/.pdf", "CL_TYPE_PNG", None), ("x.tar.GZ", "CL_TYPE_PNG", "不符"), (None, "CL_TYPE_PNG", None), ("a.pdf", "CL_TYPE_ANY", None)]
    df = spark.createDataFrame(rows, "f string, c string, w string").withColumn("k", F.struct(F.lit("n").alias("name"), F.col("c").alias("cl_type"), F.lit(None).cast("string").alias("suspect")))
    for r in df.select("f", "w", filetype.mismatch(F.col("f"), F.col("k")).alias("m"), F.size(filetype.signals(F.col("f"), F.col("k"))).alias("n")).collect():
        assert (r.m is None) == (r.w is None) and (r.w is None or r.w in r.m) and r.n == (r.w is not None), r


def test_bloom_has_no_false_negatives(spark):
    import hashlib

    rows = [(hashlib.sha256(b"%d" % i).hexdigest(), "a" if i % 2 else "b") for i in range(500)]
    rows += [(hashlib.sha256(b"y%d" % i).hexdigest(), "large") for i in range(6000)] + [(None, "a")]
    made = {r.shard: (r.bits, r.items) for r in bloom.build(spark.createDataFrame(rows, "hash string, shard string").repartition(5), "hash", "shard").collect()}
    assert {s: n for s, (_, n) in made.items()} == {"a": 250, "b": 250, "large": 6000}
    assert all(bloom.holds(made[s][0], bytes.fromhex(h), made[s][1]) for h, s in rows if h)
    for bits, items in made.values():  # each is as large as its shard needs
        assert sum(bloom.holds(bits, hashlib.sha256(b"x%d" % i).digest(), items) for i in range(2000)) < 60


def test_entropy_reads_whole_contents(spark):
    whole = spark.range(1).select(pe.entropy_column(F.encode(F.concat(F.repeat(F.lit("a"), 5 << 20), F.repeat(F.lit("b"), 5 << 20)), "UTF-8"))).first()[0]
    assert whole == 1.0


@pytest.mark.parametrize("n,want", [(2 * 1024, "2KB"), (3 << 20, "3MB"), (1023, "0KB")])
def test_size_kb(spark, n, want):
    assert spark.range(1).select(digests.size_kb(F.lit(n))).first()[0] == want


def test_edit_distance_equals_the_table():
    import random

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
        return row[-1]

    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 64))) for _ in range(2))
        assert ctph._edit(a, b) == slow(a, b)
