import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lithos.llm import op1_decontaminate as op1
from lithos.llm import op2_secrets as op2
from lithos.llm import op5_lines as op5
from lithos.llm import op7_pii as op7

from .brute import PRIVATE, SECRET, disclosing, edits_in, frame, kept_lines, span_digest, spans

HEX = "0123456789abcdef" * 2
TRICKY = [
    None, "", " ", "password=short", "Password: 'abcdef' secret=" + HEX, "TOKEN = x.y=z_/+-12", "api_key=apikey=abcdefg", "AKIA" + "Z" * 16 + " AKIAZ", HEX + "g" + HEX,
    "ſecret=abcdef toKen=abcdef", "é token:abcdef é " + HEX, "x" * 50_000 + " secret=" + "a" * 50_000, "a" * 30_000, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20,
    "a@b.c_x@y.z", "é a.b@c-d.ef. 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255", "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (555) 123-4567 +1-- +123456789012345678", "1" * 40_000, "1 " * 30_000, "a.a" * 9000 + "@" + "b.c" * 9000,
    "+" + "1." * 20_000, "me@x.org " * 700, "+49 30 1234567\n+49 30 1234567 😀 q@w.e 4111111111111111",
]
alphabet = st.text(alphabet="aA1@.+- =:\"'4_é\nkey", max_size=60)


def test_secrets_follow_the_patterns(spark):
    docs = frame(spark, list(enumerate(TRICKY)) + [(None, "secret=abcdefg"), (5, TRICKY[5])])
    got = op2.by_path(docs, op2.scan_unseen(docs)).collect()
    assert len(got) == len(TRICKY) + 2
    for row in got:
        text = "secret=abcdefg" if row.doc_id is None else TRICKY[row.doc_id]
        base = [(f.rule, f.start, f.end) for f in row.findings if f.rule in SECRET]
        assert base == spans(text, SECRET, True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="secrtokn=:\"' abcdef0189AKI_pywd", max_size=80))
def test_secrets_any_text(text):
    assert [(r, a, b) for r, _, a, b in op2.find(text, op2.BASE)] == spans(text, SECRET, True)


def test_ledger_scans_only_what_is_new(spark):
    docs = frame(spark, [(1, "secret=abcdefg"), (2, "secret=abcdefg"), (3, "nothing"), (4, HEX)])
    first = op2.scan_unseen(docs, op2.BASE).cache()
    assert first.count() == 3
    ledger, known = op2.ledger_rows(first).cache(), op2.findings_rows(first).cache()
    assert ledger.count() == 9 and known.count() == 2
    assert op2.scan_unseen(docs, op2.BASE, ledger).count() == 0
    more = docs.unionByName(frame(spark, [(5, HEX), (6, "token=1234567")]))
    newer = (op2.BASE[0]._replace(version=2), *op2.BASE[1:])
    second = op2.scan_unseen(more, newer, ledger).cache()
    scanned = {tuple(sorted(r.scanned)) for r in second.collect()}
    assert scanned == {("assign:2",), ("access:1", "assign:2", "hex:1")}
    paths = {r.doc_id: [(f.rule, f.version) for f in r.findings] for r in op2.by_path(more, second, newer, known).collect()}
    assert paths == {1: [("assign", 2)], 2: [("assign", 2)], 3: [], 4: [("hex", 1)], 5: [("hex", 1)], 6: [("assign", 2)]}


def test_history_reads_each_blob_once(spark):
    """Rows of all versions get their findings; of a later version only blobs that no earlier one had are read."""
    rows = [(i, TRICKY[i % len(TRICKY)]) for i in range(60)] + [(None, None), (70, "same"), (70, "same")]
    docs = frame(spark, rows).withColumn("_path", F.lit(1)).withColumn("blob", F.lit(2))
    history = op2.scan_history([docs.where("doc_id < 9"), docs, docs])
    early, every = {t or "" for i, t in rows if i is not None and i < 9}, {t or "" for _, t in rows}
    assert history.scanned == (len(early), len(every - early), 0)
    assert history.ledger.count() == len(every) * len(op2.RULES)
    got = op2.by_path(docs, None, known=history.known).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert [(f.rule, f.start, f.end) for f in r.findings if f.rule in SECRET] == spans(texts[r.doc_id], SECRET, True)
    again = op2.scan_history([frame(spark, [(1, "new " + HEX)])], before=history)
    assert again.scanned == (*history.scanned, 1)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert op2.scan_history([none, none]).scanned == (0, 0)
    assert op2.by_path(none, op2.scan_unseen(none)).count() == 0
    assert op7.detect(none).count() == 0 and op7.sanitise(none).count() == 0
    assert op5.dedup(none).count() == 0
    assert op1.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_private_data_follows_the_patterns(spark):
    docs = frame(spark, list(enumerate(TRICKY)) + [(None, None), (5, TRICKY[5])])
    got = op7.detect(docs).collect()
    assert len(got) == len(TRICKY) + 2
    for row in got:
        found = [(k, s.start, s.end) for k in op7.KINDS for s in row[k]]
        assert found == spans(None if row.id is None else TRICKY[row.id], PRIVATE, False), row.id


def test_private_data_in_random_texts(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aA1@.+- ()4é_%"), rng.integers(0, 90))) for _ in range(3000)]
    rows = op7.found(frame(spark, list(enumerate(texts)))).collect()
    for row in rows:
        assert span_digest([(k, s.start, s.end) for k in op7.KINDS for s in row[k]]) == span_digest(spans(texts[row.id], PRIVATE, False)), texts[row.id]


def test_disclosing_terms(spark):
    rows = [(i, f"meeting with smithson about taxes, mail j.s@x.org now {i}") for i in range(4)] + [(10 + i, "meeting about taxes and mail now with everyone") for i in range(40)]
    docs = frame(spark, rows + [(99, None)])
    got = {r.id: r for r in op7.detect(docs).collect()}
    assert {rows[0][1][t.start : t.end] for t in got[0].terms} == {"smithson"} and got[0].terms[0].action == "remove"
    assert all(not got[i].terms for i in (10, 30, 99))
    clean = {r.doc_id: r.text for r in op7.sanitise(docs).collect()}
    assert clean[2] == "meeting with [TERM] about taxes, mail [EMAIL] now 2" and clean[10] == rows[4][1] and clean[99] is None


def test_disclosing_terms_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("", "ly", "ing", "é")]
    kinds = ["x@y.org", "m@n.de", "1.2.3.4", "+49 30 1234567"]
    rows = []
    for i in range(150):
        text = list(rng.choice(words, rng.integers(0, 9))) + list(rng.choice(kinds, int(rng.integers(0, 3)) if i % 4 == 0 else 0))
        if i % 3 == 0:
            text.append("".join(rng.choice(list("qrstuvw"), 3)))
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
    rows += [(500, " ".join(f"u{i}@host{i}.net" for i in range(300)) + " " + "far " * 400 + "away"), (501, None), (502, ""), (503, "one@every.where alone"), (503, "one@every.where alone")]
    want = disclosing(rows)
    assert len(want) > 20
    for r in op7.detect(frame(spark, rows)).collect():
        text = dict(rows)[r.id] or ""
        base = [(s.start, s.end) for k in op7.KINDS for s in r[k]]
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in want]
        assert [(t.start, t.end) for t in r.terms] == [(a, b) for a, b in spots if not any(x < b and a < y for x, y in base)]
        assert all(abs(t.ratio - want[text[t.start : t.end].lower()]) < 1e-6 for t in r.terms)


def test_terms_of_rare_entities_are_marked_everywhere(spark):
    far = "meeting about taxes and mail now with everyone " * 3
    rows = [(1, f"contact zanzibar via a.b@x.org today {far}zanzibar"), (2, "Zanzibar plans"), (3, "call c@y.org for everyone")]
    rows += [(10 + i, "meeting about taxes, contact plans and mail today, call everyone now via with for") for i in range(40)]
    docs = frame(spark, rows + [(None, None)])
    got = {r.id: r for r in op7.detect(docs).collect()}
    assert {i: [rows[i - 1][1][t.start : t.end] for t in got[i].terms] for i in (1, 2, 3)} == {1: ["zanzibar"] * 2, 2: ["Zanzibar"], 3: []}
    assert not got[20].terms and got[2].terms[0].action == "generalise" and abs(got[2].terms[0].ratio - np.log2(44 / 2) / np.log2(44)) < 1e-8
    clean = {r.doc_id: r.text for r in op7.sanitise(docs).collect()}
    assert clean[1] == f"contact za... via [EMAIL] today {far}za..." and clean[2] == "Za... plans" and clean[3] == "call [EMAIL] for everyone" and clean[None] is None


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["the", "of", "and", "x1", "user", "2024", "in", "at"]
    shared = [" ".join(rng.choice(words, n)) for n in (3, 4, 5, 6, 60, 70)]
    rows = []
    for i in range(60):
        lines = [str(rng.choice(shared)) if rng.random() < 0.4 else " ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(rng.integers(1, 7))]
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, f"take the long {x} way home from {y} now") for i, (x, y) in enumerate((x, y) for x in ("old", "new") for y in "abcdefgh")]
    rows += [(300 + i, "yes") for i in range(70)] + [(400 + i, "no") for i in range(50)] + [(500 + i, " ".join(f"w{chr(97 + j)}" for j in range(30))) for i in range(2)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "one two three four\tfive"), (104, "one two three four\x0bfive"), (105, "one two three four five"), (106, "é" * 5000 + " " + "1" * 5000 + " z" * 3000)]
    got = {r.doc_id: r for r in op5.dedup(frame(spark, rows)).collect()}
    want = kept_lines(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert got[100].n_lines == 0 and got[101].n_lines == 1 and got[102].n_lines == 3 and got[103].n_dropped == got[104].n_dropped == got[105].n_dropped == 0
    # a single word on its sixtieth document, thirty tokens on their second
    assert [got[i].n_dropped for i in (300, 301, 369, 400, 449, 500, 501)] == [0, 1, 1, 0, 0, 0, 1]


def test_every_family_of_a_leaf_has_a_template(spark):
    """Two families of lines in one leaf, of different size, whose variable field has no digit; also shared equally."""
    for many in (30, 12):
        rows = [(i, f"job of user {chr(97 + i)}{chr(98 + i)} has started on the main host and waits for input") for i in range(many - 20 if many == 30 else 12)]
        rows += [(100 + i, f"job of user {chr(97 + i)}{chr(98 + i)} was removed by an operator because it ran too long") for i in range(12)]
        got = {r.doc_id: r.text for r in op5.dedup(frame(spark, rows)).collect()}
        assert got == kept_lines(rows) and [i for i, t in got.items() if t] == [0, 100]


def test_repeated_rows_and_clashing_columns(spark):
    long = "a b c d " * 5
    rows = [(1, f"{long}\nunique here now")] * 2 + [(2, long), (3, long), (None, long)]
    docs = frame(spark, rows).selectExpr("*", "1 AS n_lines", "2 AS dropped", "3 AS pos", "4 AS terms", "5 AS email", "6 AS _k1", "7 AS _dropped", "8 AS _row", "9 AS `a.b`")
    out = op5.dedup(docs).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in out) == [(0, long), (1, "unique here now"), (1, "unique here now"), (2, ""), (3, "")]
    assert {(r._k1, r._dropped, r._row, r["a.b"]) for r in out} == {(6, 7, 8, 9)} and sorted(r.n_dropped for r in out) == [0, 1, 1, 1, 1]
    got = op7.sanitise(docs).collect()
    assert len(got) == 5 and {(r._k1, r._dropped, r._row, r.n_lines) for r in got} == {(6, 7, 8, 1)}


def test_myers_equals_the_table():
    rng = np.random.default_rng(1)
    for _ in range(400):
        text = "".join(rng.choice(list("abc"), rng.integers(1, 60)))
        pattern = "".join(rng.choice(list("abc"), rng.integers(1, 90)))
        most = int(rng.integers(0, 12))
        found = op1.ends(pattern, text, most)
        want = edits_in(pattern, text, most)
        least = min((d for _, d in found), default=None)
        assert least == want or (want == len(pattern) and least is None)  # the empty part


def test_pigeonhole_finds_every_edited_item(spark):
    rng = np.random.default_rng(2)
    items = [(i, "".join(rng.choice(list("abcdefgh "), 120)).strip()) for i in range(8)] + [(8, None), (9, "  "), (3, "tiny ITEM")]
    rows = []
    for i in range(60):
        body = list("".join(rng.choice(list("abcdefgh "), 400)))
        if i % 3:
            item = list(items[i % 8][1])
            for _ in range(i % 9):
                at = int(rng.integers(0, len(item)))
                item[at : at + int(rng.integers(0, 2))] = [str(rng.choice(list("abxyz")))][: int(rng.integers(0, 2))]
            body[200:200] = item
        rows.append((i, "".join(body)))
    rows += [(100, None), (101, ""), (102, "A  Tiny\titem!"), (103, "x" * 100_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id, r.distance) for r in op1.contamination(docs, bench).collect()}
    want = set()
    for d, text in rows:
        for i, item in items:
            item = op1.normal(item)
            if item and (n := edits_in(item, op1.normal(text), int(0.05 * len(item)))) is not None and n < len(item):
                want.add((d, i, n))
    assert got == want and (102, 3, 0) in got
    left = {r.doc_id for r in op1.decontaminate(docs, bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _, _ in got}


def test_blocks_of_items_all_count(spark, monkeypatch):
    monkeypatch.setattr(op1, "BLOCK_CHARS", 10)
    bench = spark.createDataFrame([(i, f"item number {i} of the test") for i in range(5)], "item_id long, text string")
    docs = frame(spark, [(i, f"here is item number {i} of the test, quoted") for i in range(6)])
    assert {(r.doc_id, r.item_id) for r in op1.contamination(docs, bench).collect()} >= {(i, i) for i in range(5)}
    assert {r.doc_id for r in op1.decontaminate(docs, bench).collect()} <= {5}


def test_ids_and_columns_of_any_kind(spark):
    bench = spark.createDataFrame([("q1", "which of these is the right answer to give")], "item_id string, text string")
    docs = frame(spark, [(1, "so which of these is the right answer to give?"), (2, "no"), (None, None)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumn("item_id", F.lit(3)).withColumn("id", F.lit(4))
    assert [(r.doc_id, r.item_id, r.distance) for r in op1.contamination(docs, bench).collect()] == [("d1", "q1", 0)]
    left = op1.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {"d2", None}


def test_patterns_have_no_recursion():
    assert re.fullmatch(r"[0-9]{24,}", "1" * 10**6)
