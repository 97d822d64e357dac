import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos import queries
from lithos.functions import ctph, tlsh
from lithos.operators import packer, rules, serving, similarity, stores
from lithos.plans import scan
from lithos.sources import files
from lithos.streaming import service

from .test_functions import executable

RULES = r"""
/* comment */
rule Text : tag { meta: severity = "test" weight = 9 packer = "Acme" strings: $a = "MARKER" nocase $w = "Wide" wide $q = "a\"b\x41" condition: $a or $w or $q }
rule Hex { strings: $h = { 4D 5A ?? 90 } $s = ".acme" ascii condition: uint16(0) == 0x5A4D and ($h or $s) } // more
rule Two { strings: $b1 = "one" $b2 = "two" $c = "three" condition: 2 of ($b*, $c) or all of them }
rule Not { strings: $x = "xyz" condition: not $x and any of them }
"""


def test_rules(spark):
    samples = [b"some marker", "Wide".encode("utf-16le"), b"Wide", b'a"bA', b"MZ\x01\x90", b"MZ .acme", b"XMZ\x01\x90", b"one two", b"one", b"xyz"]
    want = [["Text"], ["Text"], [], ["Text"], ["Hex"], ["Hex"], [], ["Two"], [], []]
    df = spark.createDataFrame([(i, bytes(b)) for i, b in enumerate(samples)], "i int, content binary")
    got = {r.i: r.rule_hits for r in rules.scan(df, rules.parse(RULES)).collect()}
    assert [[h.rule for h in got[i]] for i in range(len(samples))] == want
    assert got[0][0].meta["severity"] == "test" and got[0][0].strings == ["$a"]
    assert [d.name for d in rules.scan(df, rules.parse(RULES)).select(rules.detections(F.col("rule_hits")).alias("d")).collect()[0].d] == ["Text"]


def test_bad_rule_files_are_left_out():
    bad = ["rule A { condition: filesize > 3 }", "rule A { strings: $a = /re/ condition: $a }", "rule A { strings: $a = { 4? } condition: $a }", "rule A { condition: $b }", "rule A {", 'rule A { strings: $a = "x" condition: $a and }']
    good, errors = rules.load({**{f"b{i}": t for i, t in enumerate(bad)}, "good": RULES})
    assert [r.name for r in good] == ["Text", "Hex", "Two", "Not"] and len(errors) == len(bad)


@pytest.mark.parametrize("weight,score,confidence", [(1, 20, "low"), (2, 32, "medium"), (3, 44, "high"), (5, 60, "high"), (9, 60, "high")])
def test_family_scores(spark, weight, score, confidence):
    row = packer.families(spark.createDataFrame([(1, "UPX", weight)], "sample_id long, family string, weight int")).first()
    assert (row.score, row.confidence) == (score, confidence)


def test_heuristics_alone(spark):
    none = spark.createDataFrame([], "sample_id long, family string, weight int")
    h = spark.createDataFrame([(1, w) for w in (10, 10, 15, 15, 15)] + [(2, 15), (2, 15)], "sample_id long, weight int")
    got = {r.sample_id: r for r in packer.fuse(none, h).collect()}
    assert got[1].detected and got[1].packed_score == 40 and got[1].confidence == "medium" and not got[2].detected


def test_packed_sample(spark):
    packed = executable(sections=((b"UPX0", 0xE0000020, b"\x60\xbe" + b"\0" * 510),), overlay=b"xx UPX! xx")
    df = spark.createDataFrame([(1, "a.exe", packed), (2, "b.txt", b"text " * 20)], "sample_id long, filename string, content binary")
    info = scan.static_info(scan.first_phase(df)).cache()
    rows = {r.sample_id: r for r in info.collect()}
    assert rows[2].pe is None and rows[1].imphash and rows[1].authentihash
    got = packer.detect(info.select("sample_id", "content", "pe"), rules.parse(RULES)).collect()
    assert len(got) == 1 and got[0].packers[0] == "UPX" and got[0].confidence == "high"


def test_stores(spark):
    digest = lambda c: c * 64
    lines = spark.createDataFrame([(0, "# x"), (1, ""), (2, f"{digest('A')}:32:Name.a"), (3, f" {digest('a')} : * : second "), (4, f"{'b' * 32}:1:md5"), (5, "zz:1:n"), (6, f"{digest('c')}:0:any:more"), (7, f"{digest('d')}:x:n"), (8, "a:b")], "seq long, value string")
    rows = stores.parse_hdb(lines)
    assert {r.seq: r.status for r in rows.collect()} == {2: "ok", 3: "ok", 4: "skipped", 5: "bad", 6: "ok", 7: "size", 8: "bad"}
    store = stores.first_wins(rows.where("status = 'ok'").drop("status"), ["hash"])
    got = {r.hash[0]: (r.size, r.name) for r in store.collect()}
    assert got == {"a": (32, "Name.a"), "c": (None, "any")}
    for layout, n in (("hex", 256), ("modulo", 64), ("modulo", 512), ("hex", 256)):
        moved = stores.with_shard(store, layout, n)
        assert sorted(r.hash for r in moved.collect()) == sorted(r.hash for r in store.collect())
    new = store.limit(0).unionByName(spark.createDataFrame([("e" * 64, 9, 5, "n5"), ("e" * 64, 10, 6, "n6"), ("a" * 64, 11, 7, "x")], "hash string, seq long, size long, name string"))
    more = stores.add(store, new, ["hash"])
    assert more.count() == 3 and more.where("name = 'n5'").count() == 1
    assert stores.delete(more, new, ["hash"]).count() == 1


def test_upsert_keeps_the_place_and_evicts_the_oldest(spark):
    lib = spark.createDataFrame([(f"k{i}", i, i * 10) for i in range(5)], "key string, seq long, size long")
    out = stores.upsert(lib, spark.createDataFrame([("k1", 7, 99), ("k9", 8, 1)], "key string, seq long, size long"), "key", ["size"])
    assert {(r.key, r.seq, r.size) for r in out.collect()} >= {("k1", 1, 99), ("k9", 8, 1)} and out.count() == 6
    assert {r.key for r in stores.keep_newest(out, 3).collect()} == {"k9", "k4", "k3"}


def test_pruned_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    raw = [bytearray(rng.bytes(35)) for _ in range(60)]
    raw += [bytearray(b[:3] + bytes(x ^ int(rng.integers(0, 2)) for x in b[3:])) for b in raw]
    for b in raw[60:]:
        b[1] = b[1] + 16 & 255
    rows = [(i, bytes(b).hex().upper()) for i, b in enumerate(raw)]
    df = spark.createDataFrame(rows, "id long, tlsh string")
    for t in (0, 11, 12, 40, 100):
        got = {(r.id, r.e_id, r.distance) for r in similarity.tlsh_join(df, df, t).collect()}
        want = set()
        for i, a in rows:
            d = tlsh.distances(np.repeat(np.frombuffer(bytes.fromhex(a), np.uint8)[None], len(rows), 0), np.stack([np.frombuffer(bytes(b), np.uint8) for b in raw]))
            want |= {(i, j, int(x)) for j, x in enumerate(d) if x <= t and rows[j][1] != a}
        assert got == want, t


def test_few_digests_are_compared_in_full(monkeypatch):
    """A bound on the codes leaves few of the pairs whose headers agree, and loses none that is near."""
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (2000, 35), np.uint8)
    rows[:, 1:3] = rows[0, 1:3]
    rows[1000:1200, :] = rows[:200, :]
    for i in range(1000, 1200):
        rows[i, rng.integers(3, 35, i % 9)] ^= 1
    full, part = [], tlsh._part
    monkeypatch.setattr(tlsh, "_part", lambda *a: full.append(out := part(*a)) or out)
    got = set(zip(*(x.tolist() for x in tlsh.nearest(rows, rows, 40)), strict=True))
    every = [tlsh.distances(np.repeat(rows[i : i + 1], len(rows), axis=0), rows) for i in range(len(rows))]
    assert got == {(i, int(j), int(d[j])) for i, d in enumerate(every) for j in np.flatnonzero((d <= 40) & (d > 0))}
    assert got and sum(x.size for x in full) < 0.05 * len(rows) ** 2


def test_nearest_digests_of_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PROBES", 20)
    monkeypatch.setattr(similarity, "ENTRIES", 7)
    monkeypatch.setattr(tlsh, "_BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.bytes(35)
    forms = [(base[:3] + bytes(x ^ int(rng.integers(0, 2)) for x in base[3:])).hex().upper() for _ in range(25)]
    rows = [(int(i), forms[int(rng.integers(0, 25))]) for i in rng.permutation(80)] + [(80, "X"), (81, None)]
    df = spark.createDataFrame(rows, "id long, tlsh string").withColumn("seq", F.col("id"))
    raw = lambda x: np.frombuffer(bytes.fromhex(x), np.uint8)[None]
    far = {(a, b): int(tlsh.distances(raw(a), raw(b))[0]) for a in forms for b in forms}
    for search, seen in ((similarity.tlsh_top, lambda i, j: True), (similarity.tlsh_replay, lambda i, j: j < i)):
        got = {(r.id, r["rank"]): (r.distance, r.e_tlsh, r.e_id) for r in search(df, df, "id", 40, 9).collect()}
        want = {}
        for i, a in rows[:80]:
            best = sorted((far[a, b], b, j) for j, b in rows[:80] if b != a and far[a, b] <= 40 and seen(i, j))[:9]
            want |= {(i, n): x for n, x in enumerate(best, 1)}
        assert got == want and any(x[0] <= 40 for x in want.values())


def test_search_forms_no_pair_of_rows(spark, tmp_path):
    """Distances are told within blocks: no join's output grows with the square of the rows."""
    spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for search in (queries.library_replay, queries.tlsh_search, queries.tlsh_topk):
        plan = search(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "fast_distance" not in plan


def test_piecewise_search(spark):
    rng = np.random.default_rng(3)
    base = rng.bytes(4000)
    texts = [base, base[:2000] + b"mid" + base[2000:], base + base[:3500]] + [rng.bytes(700) for _ in range(30)]
    df = spark.createDataFrame([(i, len(t), ctph.digest(t)) for i, t in enumerate(texts)], "id long, size long, ssdeep string")
    hits = {(r.id, r.e_id): r.score for r in similarity.ssdeep_top(df, df, "id", "id", 1).collect()}
    brute = {(a.id, b.id): s for a in df.collect() for b in df.collect() if a.id != b.id and max(1, a.size // 2) <= b.size <= a.size * 2 and (s := ctph.compare(a.ssdeep, b.ssdeep)) >= 1}
    assert hits == brute and hits[0, 1] >= 90
    short = spark.createDataFrame([(1, 40, "3:ab:cd"), (2, 40, "3:abcdefgh:cd"), (3, 40, "6:q:r")], "id long, size long, ssdeep string")
    assert {(r.id, r.e_id) for r in similarity.ssdeep_without_grams(short, short).collect()} == {(1, 2), (1, 3), (3, 1), (3, 2)}


def test_piecewise_candidates_equal_shared_grams(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("ABab"), n))
    parts = [word(int(n)) for n in rng.integers(5, 13, 8)]
    some = lambda: "".join(parts[int(i)] for i in rng.integers(0, 8, 2))
    rows = [(i, int(rng.integers(1, 400)) if i % 9 else None, f"{3 * 2 ** int(rng.integers(0, 3))}:{some()}:{some()}") for i in range(120)]
    rows += [(1000 + i, n, s) for i, n, s in rows[:30]] + [(2000, 5, None), (2001, 5, "3:a!bcdefgh:abcdefg"), (2002, 5, "x:ABABABAB:ABABABAB")]
    df = spark.createDataFrame(rows, "id long, size long, ssdeep string")
    by_gram = similarity.probe_grams(df.select("id", "ssdeep")).select("id", "blocksize", "gram").join(similarity.entry_grams(df.select("id", "ssdeep")), ["blocksize", "gram"]).select("id", "e_id").distinct()
    met = {(r.id, r.e_id) for r in by_gram.collect()}
    of = {i: (n, s) for i, n, s in rows}
    fit = lambda n, m: (n or 0) <= 0 or m is None or n // 2 <= m <= n * 2
    want = {(i, j) for i, j in met if of[i][1] != of[j][1] and fit(of[i][0], of[j][0])}
    got = [(r.id, r.e_id) for r in similarity.ssdeep_candidates(df, df, "id", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    # copies meet as one digest, and are told apart only afterwards
    a, b = "3:ABCDEFGHIJKLMNOPQRST:x", "3:ABCDEFGHIJKLMNOPQRSTz:x"
    copies = spark.createDataFrame([(i, 5, (a, b)[i % 2]) for i in range(40)], "id long, size long, ssdeep string")
    assert {tuple(r) for r in similarity._ssdeep_pairs(copies, copies, "id", "id", "size").collect()} == {(a, b), (b, a)}
    assert similarity._ssdeep_pairs(copies, copies, "id", "id", "size").count() == 2 and similarity.ssdeep_candidates(copies, copies, "id", "id").count() == 800


def fold(times, window, limit):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if t - k <= window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def test_rate_limit(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"c{i % 3}", start + dt.timedelta(seconds=int(s))) for i, s in enumerate(np.sort(rng.integers(0, 900, 300)))] + [(1000 + i, "edge", start + dt.timedelta(seconds=s)) for i, s in enumerate((0, 60, 121))]
    df = spark.createDataFrame(rows, "id long, client string, ts timestamp")
    got = {r.id: r.accepted for r in serving.rate_limited(df, "client", "ts", "id", 60, 4).collect()}
    for c in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == c)
        assert [got[i] for _, i in mine] == fold([t.timestamp() for t, _ in mine], 60, 4)
    assert serving.rate_limited(df, "client", "ts", "id", 60, 0).where("NOT accepted").count() == 0


def test_rate_limit_keeps_every_row(spark):
    """Null keys are one client; equal rows stay as many as they are; other columns pass whatever their names."""
    at = dt.datetime(2024, 1, 1)
    rows = [(1, None, at), (1, None, at), (2, "a", at), (2, "a", at), (3, "a", at + dt.timedelta(seconds=70))]
    df = spark.createDataFrame(rows, "id long, client string, ts timestamp").withColumns({"_row": F.lit(1), "_t": F.lit(2), "_session": F.lit(3)})
    got = serving.rate_limited(df, "client", "ts", "id", 60, 1)
    assert got.columns == [*df.columns, "accepted"]
    assert sorted((r.client or "", r.id, r.accepted) for r in got.collect()) == [("", 1, False), ("", 1, True), ("a", 2, False), ("a", 2, True), ("a", 3, True)]


def test_lines_are_ordered_by_file_and_place(spark, tmp_path):
    """Large files are read first and in blocks: the order of lines does not follow that."""
    from lithos.sources import files

    (tmp_path / "a.hdb").write_text("".join(f"a{i}\n" for i in range(3)))
    (tmp_path / "b.hdb").write_text("".join(f"b{i:05d}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = [r.value for r in files.lines(spark, str(tmp_path)).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{i}" for i in range(3)] + [f"b{i:05d}" for i in range(4000)]


def test_histories_and_percentiles(spark):
    old = spark.createDataFrame([("a", "f1", 1, 1), ("a", "f1", 1, 2)], "k string, f string, t long, seq long")
    new = spark.createDataFrame([("a", "f1", 1, 3), ("a", "f2", 2, 4), ("a", "f2", 2, 5)], "k string, f string, t long, seq long")
    assert sorted(r.seq for r in serving.merged_history(old, new, "k", ["f", "t"], "seq").collect()) == [1, 2, 4]
    values = [float(x % 7) for x in range(101)]
    got = {r.percent: r.value for r in serving.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0, 50, 99, 100]).collect()}
    ranked = sorted(values)
    assert got == {p: ranked[min(100, int(101 * p / 100))] for p in (0, 50, 99, 100)}


def test_report_of_nothing_known(spark):
    df = spark.createDataFrame([(1, "a.txt", b"clean words here"), (2, "b.pdf", b"MARKER words")], "sample_id long, filename string, content binary")
    none = spark.createDataFrame([], "hash string, size long, name string")
    got = {r.sample_id: r for r in scan.report(df, none, none, rules.parse(RULES)).collect()}
    assert got[1].verdict == "CLEAN" and got[1].clean and got[1].scanners == ["SHA256 Hash DB", "MD5 Hash DB", "YARA"]
    assert [d.engine for d in got[2].detections] == ["FileType", "YARA"] and got[2].verdict == "DETECTED"


def test_files_and_containers(spark, tmp_path):
    import io
    import tarfile

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bin").write_bytes(b"hello")
    assert [(r.filename, r.size) for r in files.samples(spark, str(tmp_path / "x")).collect()] == [("a.bin", 5)]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name in ("main.hdb", "x.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    data = b"ClamAV-VDB:now:1:2:3:md5".ljust(512) + out.getvalue()
    df = spark.createDataFrame([("daily.cvd", data), ("no.cvd", b"zz")], "filename string, content binary")
    assert [(r.name, r.member, bytes(r.content)) for r in files.container_members(df).collect()] == [("daily.cvd", "main.hdb", b"abc")]
    store = stores.with_shard(files.generated(spark, 50))
    files.write_store(store, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 50


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s), f"h{s % 4}") for s in range(0, 90, 10)]
    spark.createDataFrame(rows, "client string, submitted_at timestamp, sha256 string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("client string, submitted_at timestamp, sha256 string").parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    limited = run(service.rate_limited(source, "client", "submitted_at", 60, 3), "limited")
    assert [r.accepted for r in sorted(limited, key=lambda r: r.ts)] == fold([r[1].timestamp() for r in rows], 60, 3)
    assert len(run(service.first_submissions(source), "firsts")) == len({r[2] for r in rows})
    query = service.two_phase(source, lambda b: b.withColumn("p", F.lit(1)), lambda b: b.withColumn("p", F.lit(2)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "phase2")).count() == len(rows)


def test_searches_cover_the_whole_library(spark, tmp_path):
    rng = np.random.default_rng(11)
    text = " ".join(f"word{x}" for x in rng.integers(0, 900, 900))
    other = " ".join(f"else{x}" for x in rng.integers(0, 900, 900))
    rows = [(1, text), (3, text + " and a little more"), (5, other), (6, other + " and its end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for search in (queries.tlsh_search, queries.ssdeep_search):
        assert {(1, 3), (3, 1), (5, 6), (6, 5)} <= {(r.doc_id, r.entry) for r in search(spark, str(tmp_path)).collect()}


def test_both_phases_on_real_contents(spark):
    rng = np.random.default_rng(3)
    body = " ".join(f"word{x}" for x in rng.integers(0, 900, 900))
    packed = executable(sections=((b"UPX0", 0xE0000020, b"\x60\xbe" + b"\0" * 510),), overlay=b"xx UPX! " + body.encode())
    texts = [body.encode() + b" MARKER", (body + " and a little more").encode(), packed, b"clean"]
    df = spark.createDataFrame([(i, f"f{i}", bytes(b)) for i, b in enumerate(texts, 10)], "sample_id long, filename string, content binary")
    info = {r.sample_id: r for r in scan.static_info(scan.first_phase(df)).collect()}
    sha256 = scan.first_phase(df).where("sample_id = 10").select(F.col("sha256").alias("hash"), F.lit(None).cast("long").alias("size"), F.lit("Known").alias("name"))
    md5 = spark.createDataFrame([], "hash string, size long, name string")
    fuzzy = spark.createDataFrame([("imphash", info[12].imphash, None, "Imp", "aa")], "fuzzy_type string, value string, size long, name string, sha256 string")
    ssdeep = spark.createDataFrame([(info[11].ssdeep, 1, "bb", None, "Piece")], "ssdeep string, seq long, sha256 string, size long, name string")
    near = spark.createDataFrame([(info[11].tlsh, 1, "cc", None, None)], "tlsh string, seq long, sha256 string, size long, name string")
    first = scan.report(df, sha256, md5, [])
    second = scan.second_phase(df, rules.parse(RULES), [], fuzzy, ssdeep, near)
    whole = scan.merged(first, second).cache()
    got = {r.sample_id: r for r in whole.collect()}
    assert [(d.engine, d.type, d.name) for d in got[10].detections] == [("SHA256 Hash DB", "hash", "Known"), ("YARA", "yara", "Text"), ("SSDeep Hash DB", "fuzzy-similar", "Piece"), ("TLSH Hash DB", "fuzzy-similar", "unknown")]
    assert got[10].detections[2].score >= 90 and got[10].scanners == ["SHA256 Hash DB", "MD5 Hash DB", "YARA", "SSDeep Hash DB", "TLSH Hash DB"]
    # an equal piecewise hash is an exact hit; an equal TLSH digest is left out
    assert [(d.engine, d.type) for d in got[11].detections] == [("SSDeep Hash DB", "fuzzy")]
    assert ("Fuzzy Hash DB", "Imp") in {(d.engine, d.name) for d in got[12].detections} and got[12].static_info.packer.packers[0] == "UPX"
    assert got[13].clean and got[13].verdict == "CLEAN" and got[13].static_info.tlsh is None and "TLSH Hash DB" not in got[13].scanners
    # only what a digest store knows enters the libraries, after the search
    library = scan.grown(ssdeep, whole, "ssdeep").collect()
    assert {(r.ssdeep, r.seq, r.name) for r in library} == {(info[11].ssdeep, 1, "Piece"), (info[10].ssdeep, 10, "Known")}
    assert [r.seq for r in scan.grown(near, whole, "tlsh", most=1).collect()] == [10]


def test_large_samples_get_rules_only(spark, monkeypatch):
    monkeypatch.setattr(scan, "DEEP_BYTES", 100)
    df = spark.createDataFrame([(1, b"MARKER" + b"word one two " * 50)], "sample_id long, content binary")
    row = scan.deep(df, rules.parse(RULES), []).first()
    assert [h.rule for h in row.rule_hits] == ["Text", "Two"]
    assert row.ssdeep is None and row.tlsh is None and row.pe is None and len(row.notes) == 1
