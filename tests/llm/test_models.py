import functools
import math
import tracemalloc
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.llm import op3_mix as op3
from lithos.llm import op4_langid as op4
from lithos.llm import op9_quality as op9
from lithos.llm import op10_ctw as op10

from .brute import frame

WORDS = {"en": "the of and ing with that this is was for", "de": "der die und nicht ein zu den mit sich auf", "fr": "le les des est une dans que pour qui sur", "es": "el los las una por con para del más como"}


def prose(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang].split(), n))


def test_languages_held_out(spark):
    rng = np.random.default_rng(0)
    langs = [str(rng.choice(list(WORDS))) for _ in range(400)]
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(langs)] + [(900, None, "en"), (901, "", "de"), (902, "123 !!", "fr"), (903, "的的的", None), (904, prose(rng, "de", 30000), None), (None, prose(rng, "es"), None)]
    docs = frame(spark, rows)
    model = op4.fit(docs, F.col("doc_id") < 200)
    assert set(model.families) == {"family germanic", "family romance"} and set(model.machines) == {("family germanic", "family romance"), ("de", "en"), ("es", "fr")}
    got = {r.doc_id: (r.lang_pred, r.score) for r in op4.predict(docs, model).collect()}
    assert np.mean([got[i][0] == langs[i] for i in range(200, 400)]) > 0.97
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[904][0] == "de" and got[None][0] == "es" and got[903][0] in WORDS
    assert all(0 <= s <= 1 for _, s in got.values())


def test_languages_without_labels(spark):
    docs = frame(spark, [(1, "some text"), (2, None)])
    assert [r.lang_pred for r in op4.predict(docs, op4.fit(docs, F.lit(True))).collect()] == ["und", "und"]
    one = op4.fit(frame(spark, [(1, "some text", "en")]), F.lit(True))
    assert {r.lang_pred for r in op4.predict(docs, one).collect()} == {"en", "und"}


def test_votes_against_every_machine():
    """The walk over the levels, against each machine applied to a dense vector; many more labels than one level holds."""
    rng = np.random.default_rng(3)
    langs = ["en", "de", "fr"] + [f"x{i:03d}" for i in range(450)]
    own = {v: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12)) for v in langs}
    text = lambda v: " ".join("".join(rng.choice(list(own[v]), 4)) for _ in range(60))
    train = [(text(v), v) for v in langs for _ in range(2)]
    x = np.zeros((len(train), op4.DIMS), np.float32)
    for i, (t, _) in enumerate(train):
        x[i] = op4._scaled(np.bincount(op4.slots(t), minlength=op4.DIMS))
    model = op4.fit_arrays(x, [v for _, v in train])
    assert max(map(len, model.children.values())) <= op4.FAN and len(model.machines) < 8 * len(langs)
    tool, right = op4.Predictor(model), 0
    for v in langs[::9]:
        t = text(v)
        dense, at = op4._scaled(np.bincount(op4.slots(t), minlength=op4.DIMS)), ""
        while at in model.children:
            some = model.children[at]
            margin = {(a, b): float(dense @ model.machines[a, b].weights) + model.machines[a, b].bias for i, a in enumerate(some) for b in some[i + 1 :]}
            wins = {c: (sum(m > 0 for (a, _), m in margin.items() if a == c) + sum(m < 0 for (_, b), m in margin.items() if b == c), sum(m for (a, _), m in margin.items() if a == c) - sum(m for (_, b), m in margin.items() if b == c)) for c in some}
            at = max(some, key=wins.get)
        got, sure = tool.predict(t)
        right += got == v
        assert got == at and 0 <= sure <= 1
    assert right > 25


def test_quality_learns_from_document_labels(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(300):
        good = bool(rng.random() < 0.7)
        text = prose(rng, "en", 200)
        if not good:  # one bad passage among good ones
            text = prose(rng, "en", 64) + " " + " ".join(w.upper() + "!!" for w in prose(rng, "en", 64).split()) + " " + prose(rng, "en", 64)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (None, "the of and"), (902, "x" * 100_000)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (5, None, None), (950, 1, 0)], "doc_id long, quality int, toxic int")
    net = op9.fit(docs, marks, F.col("doc_id") < 200)
    got = {r.doc_id: r.score for r in op9.score(docs, net).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(labels[i][1]) for i in range(200, 300)]) > 0.95
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values()) and None in got
    whole = op9.score(docs.withColumn("_score", F.lit("mine")), net, whole_rows="_score_")
    assert whole.columns == [*docs.columns, "_score", "_score_"] and whole.count() == len(rows)
    twice = op9.score(docs.unionByName(docs.where("doc_id = 902")), net).where("doc_id = 902").collect()
    assert twice[0] == twice[1]


def test_quality_reads_words(spark):
    """Good and bad texts of the same letters, lengths and marks: only their words differ."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    text = lambda good: " ".join(rng.choice(words[:30] if good else ["".join(sorted(w)) for w in words[:30]], 150))
    rows = [(i, text(i % 2)) for i in range(160)]
    docs = frame(spark, rows)
    net = op9.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int"), F.col("doc_id") < 100)
    assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in op9.score(docs, net).where("doc_id >= 100").collect()]) > 0.95


def test_quality_of_long_texts(spark, monkeypatch):
    """A training text lends all its passages, or is no part of the sample; long texts are scored in parts."""
    long = " ".join(prose(np.random.default_rng(1), "en", 64) for _ in range(200))
    rows = [(1, long), (2, "short good one"), (3, "BAD !!"), (4, "also GOOD"), (5, "!! ?? BAD")]
    docs, marks = frame(spark, rows), spark.createDataFrame([(i, int(i not in (3, 5)), 0) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    seen = []
    fit = op9.fit_bags
    monkeypatch.setattr(op9, "fit_bags", lambda bags, y: seen.append(sorted(len(b) for b in bags)) or fit(bags, y))
    net = op9.fit(docs, marks, F.lit(True))
    op9.fit(docs, marks, F.lit(True), most_passages=100)
    assert seen == [[1, 1, 1, 1, 200], [1, 1, 1, 1]]
    whole = net.scores([long, "x"])
    monkeypatch.setattr(op9, "TOGETHER", 7)
    assert net.scores([long, "x"]) == pytest.approx(whole, abs=1e-5)
    chunks = op9.passages(long)
    x = op9.features(chunks, [len(chunks)] * len(chunks))
    assert op9._forward(net.weights, (x - net.mean) / net.scale, np.array([0]))["p"][0] == pytest.approx(whole[0], abs=1e-5)


def test_quality_gradients():
    rng = np.random.default_rng(1)
    x, starts, y = rng.normal(size=(9, op9.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    w = {k: rng.normal(size=s) for k, s in {"e": (op9.FEATURES, 3), "e0": (3,), "v": (3, 2), "u": (3, 2), "a": (2,), "c": (3,), "c0": (1,)}.items()}
    loss = lambda: float(np.mean([-math.log(p if t else 1 - p) for p, t in zip(op9._forward(w, x, starts)["p"], y)]))
    for k, d in op9._gradients(w, x, starts, y, 0.0).items():
        flat, at = w[k].reshape(-1), int(rng.integers(0, w[k].size))
        old = flat[at]
        flat[at] = old + 1e-6
        up = loss()
        flat[at] = old - 1e-6
        down = loss()
        flat[at] = old
        assert d.reshape(-1)[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_quality_holds_the_passages_once():
    rng = np.random.default_rng(5)
    bags, y = [rng.random((200, op9.FEATURES), np.float32) for _ in range(200)], np.arange(200) % 2.0
    size = sum(b.nbytes for b in bags)
    tracemalloc.start()
    try:
        net = op9.fit_bags(bags, y, rounds=1)
        assert tracemalloc.get_traced_memory()[1] < 1.5 * size
    finally:
        tracemalloc.stop()
    x = np.concatenate(bags)
    assert (net.mean == x.mean(axis=0)).all() and (net.scale == x.std(axis=0) + 0.02).all()


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "some text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in op9.score(docs, op9.fit(docs, none, F.lit(True))).collect()] == [0.5, 0.5]
    assert op9.score(frame(spark, []), op9.fit(frame(spark, []), none, F.lit(True))).count() == 0


def ctw_log10(train, data, depth, contexts=None):
    """The weighted mixture, node by node; contexts that are not kept are one child of the longest kept one."""
    pad = b"\xff" * depth
    seen, total = Counter(), Counter()
    for text in train:
        b = pad + text + b"\xff"
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                total[b[i - d : i]] += 1
                for k in range(8):
                    seen[b[i - d : i], f"{b[i]:08b}"[:k], f"{b[i]:08b}"[k]] += 1
    least = 1 if contexts is None else min((n for n in total.values() if sum(m >= n for m in total.values()) <= contexts), default=math.inf)
    kept = {s for s, n in total.items() if n >= least} | {b""}
    below = {s: [c for c in kept if len(c) == len(s) + 1 and c.endswith(s)] for s in kept}

    def counts(s, path):
        return np.array([seen[s, path, "0"], seen[s, path, "1"]])

    def rest(s, path):
        return counts(s, path) - sum((counts(c, path) for c in below[s]), np.zeros(2, int))

    def log_pe(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n.sum() + 1) - math.log(math.pi)

    @functools.cache
    def log_pw(s, path):
        own = log_pe(counts(s, path))
        return np.logaddexp(own, log_pe(rest(s, path)) + sum(log_pw(c, path) for c in below[s])) - math.log(2) if below[s] else own

    def odds(s, path):
        n = counts(s, path)
        return (n + 0.5) / (n.sum() + 1) if n.sum() else odds(s[1:], path) if s else np.array([0.5, 0.5])

    out, b = 0.0, pad + data + b"\xff"
    for i in range(depth, len(b)):
        chain = [b""]
        while len(chain) <= depth and b[i - len(chain) : i] in kept:
            chain.append(b[i - len(chain) : i])
        for k in range(8):
            path, bit = f"{b[i]:08b}"[:k], int(f"{b[i]:08b}"[k])
            n = rest(chain[-1], path)
            p = ((n + 0.5) / (n.sum() + 1) if n.sum() else odds(chain[-1], path))[bit]
            for s in reversed(chain):
                if below[s]:
                    keep = math.exp(log_pe(counts(s, path)) - log_pw(s, path) - math.log(2))
                    p = keep * odds(s, path)[bit] + (1 - keep) * p
            out += math.log10(p)
    return out


@pytest.mark.parametrize(("depth", "contexts"), [(2, None), (5, None), (5, 9), (3, 4)])
def test_ctw_against_the_tree(spark, depth, contexts):
    train = ["the cat sat", "the cat sat", "on the mat é", "", "zz zz"]
    others = [None, "", "the dog", "ÿ\x00", "the cat sat on the mat"]
    docs = frame(spark, [(i, t) for i, t in enumerate(train + others)] + [(4, "zz zz"), (None, "THE cat")]).withColumn("score", F.lit("x")).withColumn("_k1", F.lit(1))
    model = op10.fit(docs.where("doc_id < 5").distinct().select("text"), head=3, depth=depth, contexts=contexts or op10.CONTEXTS)
    got = op10.score(docs, model).collect()
    assert len(got) == len(train) + len(others) + 2
    counts = Counter()
    for t in train:
        counts.update(op10.tokens(t))
    n, v = counts.total(), len(counts)
    for row in got:
        text = "THE cat" if row.doc_id is None else (train + others)[row.doc_id]
        tokens = op10.tokens(text)
        want = ctw_log10([t.encode() for t in train], (text or "").encode(), depth, contexts)
        assert row.score == pytest.approx(want, abs=len((text or "").encode()) / op10.STEP + 1e-3)
        assert row.bits_per_byte == pytest.approx(-row.score * math.log2(10) / (len((text or "").encode()) + 1), rel=1e-9)
        assert row.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel=1e-9)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)


def test_ctw_untrained_and_long(spark, monkeypatch):
    docs = frame(spark, [(1, "ab"), (2, None)])
    empty = op10.fit(frame(spark, []).select("text"))
    assert op10.score(frame(spark, []), empty).count() == 0
    rows = {r.doc_id: r for r in op10.score(docs, empty).collect()}
    assert rows[1].score == pytest.approx(3 * math.log10(1 / 256), abs=3 / op10.STEP) and rows[1].n_known == 0 and rows[2].train_tokens == 0
    long = "the quick brown fox " * 20
    model = op10.fit(frame(spark, [(1, long)]).select("text"))
    assert model.tree.scores([long, None, "x"], most=7) == pytest.approx([model.tree.score(long), model.tree.score(None), model.tree.score("x")])
    monkeypatch.setattr(op10, "FLUSH_CODES", 7)
    parts = {r.code: r.n for r in op10._count(frame(spark, [(1, long)]).select("text"), 5).where("code IS NOT NULL").collect()}
    assert parts == Counter(op10.codes_of(b"\xff" * 5 + long.encode()).tolist())


def every_context_log10(train, probes, depth):
    """The weighted mixture of all contexts, told along each probe's own."""
    pad = b"\xff" * depth
    total, longer = Counter(), {}
    for i in range(depth, len(data := pad + train + b"\xff")):
        for d in range(depth + 1):
            longer.setdefault(data[i - d : i], set()).add(data[i - d - 1 : i] if d < depth else None)
            for k in range(9):
                total[data[i - d : i], f"{data[i]:08b}"[:k]] += 1

    def counts(s, path):
        return total[s, path + "0"], total[s, path + "1"]

    def log_pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def log_pw(s, path):
        own = log_pe(*counts(s, path))
        return own if len(s) == depth else np.logaddexp(own, sum(log_pw(c, path) for c in longer.get(s, ()))) - math.log(2)

    def told(data, i, k):
        path, bit, sure, free, odds = f"{data[i]:08b}"[:k], int(f"{data[i]:08b}"[k]), 0.0, 1.0, 0.5
        for d in range(depth + 1):
            n = counts(s := data[i - d : i], path)
            if sum(n):
                odds, own = (n[bit] + 0.5) / (sum(n) + 1), 1.0 if d == depth else math.exp(log_pe(*n) - log_pw(s, path) - math.log(2))
                sure, free = sure + free * own * odds, free * (1 - own)
        return math.log10(sure + free * odds)

    return [sum(told(data, i, k) for i in range(depth, len(data)) for k in range(8)) for data in (pad + p + b"\xff" for p in probes)]


def test_ctw_keeps_every_context(spark):
    rng = np.random.default_rng(3)
    train = bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8), 30_000)).decode()
    assert len({train[i - d : i] for d in range(6) for i in range(d, len(train))}) > 1 << 16
    probes = [train[500:540], "never met: 0815", "", None, "abc" * 5]
    want = every_context_log10(train.encode(), [(p or "").encode() for p in probes], 5)
    for hot in (op10.HOT, 1000, 0):
        model = op10.fit(frame(spark, [(1, train)]).select("text"), hot=hot)
        got = {r.doc_id: r.score for r in op10.score(frame(spark, list(enumerate(probes)) + [(2, "")]), model).collect()}
        assert [got[i] for i in range(len(probes))] == pytest.approx(want, rel=1e-9)


def within_one_block(blocks, weights):
    """The schedule of ``blocks``, held against the exact targets of every phase, slot by slot."""
    at, starts = op3.schedule(blocks, weights)
    line = sorted((t, s) for s, where in at.items() for t in where)
    assert [t for t, _ in line] == list(range(sum(blocks.values()))) and {s: len(w) for s, w in at.items()} == blocks
    left, sent, total, start = {s: n for s, n in blocks.items() if n}, Counter(), None, 0
    for t, s in line:
        if t in starts:
            left = {x: n - sent[x] for x, n in left.items() if n > sent[x]}
            sent, start, total = Counter(), t, sum(Fraction(weights[x]) for x in left)
        sent[s] += 1
        for x in left if len(left) < 40 else [s]:
            assert abs(sent[x] - (t + 1 - start) * Fraction(weights[x]) / total) < 1
    return at, starts


def test_schedule_stays_within_one_block():
    rng = np.random.default_rng(0)
    for _ in range(30):
        weights = {f"s{i}": float(w) for i, w in enumerate(rng.random(rng.integers(1, 12)) ** 3 + 1e-6)}
        within_one_block({s: int(n) for s, n in zip(weights, rng.integers(0, 300, len(weights)), strict=True)}, weights)
    within_one_block({"a": 500, "b": 2, "c": 700}, {"a": math.sqrt(2), "b": 1e-6, "c": math.pi})
    within_one_block({"a": 90, "b": 90}, {"a": Fraction(1, 3), "b": Fraction(2, 7)})


def test_schedule_of_many_slots_and_many_sources():
    at, starts = within_one_block({f"s{i}": 4600 for i in range(11)}, {f"s{i}": 1 for i in range(11)})
    assert starts[1] >= 50_000 and all(abs(sum(t < 50_400 for t in w) - 50_400 / 11) < 1 for w in at.values())
    within_one_block({f"s{i}": 1 + i % 3 for i in range(1200)}, {f"s{i}": 1 + (i * 7919) % 101 / 7 for i in range(1200)})


@pytest.mark.parametrize("bad", [0, -1.0, math.nan, math.inf])
def test_weights_that_are_refused(spark, bad):
    with pytest.raises(ValueError, match="positive"):
        op3.schedule({"a": 1, "b": 1}, {"a": 1.0, "b": bad})
    with pytest.raises(ValueError, match="positive"):
        op3.mix(frame(spark, [(1, "x", None, "a")]), {"a": bad})


def test_mix_places_every_row(spark, monkeypatch):
    monkeypatch.setattr(op3, "RUN_ROWS", 16)
    rows = [(i, f"text {i}", None, "hot" if i % 3 else f"s{i % 7}", 5) for i in range(500)] + [(None, None, None, None, None), (7, "text 7", None, "hot", 5)]
    docs = frame(spark, rows)
    for name in ("block", "_k1", "_k2", "_units", "_source", "_hash", "_run", "_bits", "_row", "_start"):
        docs = docs.withColumn(name, F.lit("x"))
    got = op3.mix(docs, {"hot": 2.0, "s0": 1.0}, block=10).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, {}).setdefault(r.block, []).append(r)
    slots = {}
    for source, blocks in by.items():
        assert sorted(blocks) == list(range(len(blocks)))
        assert all(len(b) == 10 for k, b in blocks.items() if k < len(blocks) - 1)
        at = [{r.slot for r in blocks[k]} for k in sorted(blocks)]
        assert all(len(x) == 1 for x in at) and at == sorted(at, key=min)
        for x in at:
            assert slots.setdefault(min(x), source) == source
    assert sorted(slots) == list(range(len(slots)))
    again = op3.mix(docs.repartition(7), {"hot": 2.0, "s0": 1.0}, block=10).collect()
    assert sorted((r.doc_id or -1, r.slot) for r in got) == sorted((r.doc_id or -1, r.slot) for r in again)
    assert op3.mix(frame(spark, []), block=3).count() == 0
    assert set(op3.mix(docs, block=10).columns) == {*docs.columns, "slot"} and {r._units for r in got} == {"x"}


def test_mix_follows_targets_over_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(op3, "MOST_BLOCKS", 200)
    rows = [(i, "x" * (1 + i * 37 % 90), None, f"s{i % 5 % 3}") for i in range(900)] + [(1000, "y" * 3000, None, "s0")]
    got = op3.mix(frame(spark, rows), block=10, size=F.length("text"), temperature=0.5).collect()
    total = Counter()
    for _, t, _, s in rows:
        total[s] += len(t)
    block = -(-sum(total.values()) // 200)
    at, starts = within_one_block({s: -(-total[s] // block) for s in sorted(total)}, {s: total[s] ** 0.5 for s in sorted(total)})
    assert len(got) == len(rows) and all(at[r.source][r.block] == r.slot for r in got)
