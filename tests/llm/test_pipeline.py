from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lithos.llm import common, op5_lines

from .brute import frame, jaccard, kept_lines


def test_stages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = "the of and in to that is was for with".split()
    item = "which of these answers about the moon and the tides is the right one to give"
    text = lambda n: " ".join(f"{rng.choice(words)}{rng.integers(0, 400)}x" if rng.random() < 0.5 else str(rng.choice(words)) for _ in range(n))
    shared = "a line that many documents share word for word"
    rows = []
    for i in range(60):
        body = rows[i - 1][1] if i % 10 == 1 else "\n".join([text(10) for _ in range(4)] + [f"{text(6)} {item if i % 15 == 0 else ''}", shared if i % 4 == 0 else text(5)])
        rows.append((i, body, "en", f"s{i % 3}", len(body)))
    bad = [(100 + i, " ".join(f"{w.upper()}!!" for w in text(60).split()), "en", "s0", 1) for i in range(20)]
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows + bad)

    def of(stage, df):
        out = dict(pipeline.STAGES)[stage](spark, df, str(tmp_path))
        found = out.collect()
        return spark.createDataFrame(found, out.schema), {r.doc_id: r for r in found}

    good, kept = of("quality classifier", docs)
    assert set(kept) == {r[0] for r in rows} and good.columns == docs.columns
    lined, kept = of("line dedup", good)
    assert {i: r.text for i, r in kept.items()} == kept_lines([r[:2] for r in rows]) and all(r.n_chars == len(r.text) for r in kept.values())
    want = jaccard([(i, r.text) for i, r in kept.items()])
    near, left = of("n-gram Jaccard join", lined)
    assert set(left) == {i for i, (n, c) in want.items() if c == i or not n}
    clean, left = of("benchmark decontamination", near)
    assert set(left) == {i for i, r in kept.items() if i in {x.doc_id for x in near.collect()} and item not in " ".join(r.text.lower().split())}
    mixed, last = of("mixing sources", clean)
    assert set(last) == set(left) and mixed.columns == [*docs.columns, "block", "slot"]
    assert near.count() < lined.count() and clean.count() < near.count()


def test_one_row_of_each_group_stays(spark, tmp_path):
    body = "one and the same text of more than five words"
    other = "a second text that has nothing in common with it"
    rows = [(3, body, "en", "s0", len(body))] * 5 + [(None, other, "en", "s1", len(other))] * 4 + [(9, other, "de", "s1", len(other)), (3, body, "de", "s2", len(body))]
    rows += [(None, body, "en", f"s{i}", len(body)) for i in range(3)] + [(7, " \n", "en", "s0", 2)] * 2 + [(None, None, "en", "s0", None), (8, "short", "en", "s0", 5)]
    out = pipeline.near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert out.columns == frame(spark, rows).columns
    got = sorted((r.text or "", r.doc_id is None) for r in out.collect())
    assert got == sorted([(body, True), (other, True), (" \n", False), (" \n", False), ("", True), ("short", False)])


ODD = [(None, None, None, None, None), (1, "", "en", "s0", 0), (1, "", "en", "s0", 0), (2, " \n ", None, "s1", 3), (3, "x" * 100_000, "en", None, 1), (None, "a text without an id of some words", "en", "s1", 9), (5, "twice the same row of words", "en", "s2", 1), (5, "twice the same row of words", "en", "s2", 1)]
MORE = ["_k1", "_k2", "_row", "_score", "_text", "_lines", "n_lines", "n_dropped", "dropped", "id", "digest", "points", "block", "slot", "_source", "_chunk", "_units", "a.b", "score", "item_id", "text_"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, None), (2, " "), (3, "an item that stands nowhere at all in here")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_odd_tables(spark, tables, name):
    """Nulls, empty and long texts, repeated rows, text ids, clashing names, an empty table."""
    stage = dict(pipeline.STAGES)[name]
    docs = frame(spark, ODD)
    for c in MORE:
        docs = docs.withColumn(c, F.lit("mine"))
    for df in (docs, docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), docs.where("false")):
        out = stage(spark, df, tables)
        names = [c for c in df.columns if c not in ("block", "slot")] + ["block", "slot"] if name == "mixing sources" else df.columns
        assert out.columns == names
        rows = out.collect()
        assert {r[c] for r in rows for c in MORE if c not in ("block", "slot")} <= {"mine"}
        if df.where("true").isEmpty():
            assert not rows
        elif name == "n-gram Jaccard join":
            assert len(rows) == len(ODD) - 1
            assert sum(r.text == ODD[-1][1] for r in rows) == 1 and sum(not (r.text or "").strip() for r in rows) == 4
        elif name != "quality classifier":
            assert len(rows) == len(ODD)
        else:
            assert sum(r.text == ODD[-1][1] for r in rows) in (0, 2)


def test_run_leaves_only_its_result(spark, tables, tmp_path):
    """All stages in turn; the tables of the way are gone."""
    frame(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    shared = Path(common.shared_dir(spark))
    before = set(shared.glob("*"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "slot"] and out.count() > 0
    (made,) = set(shared.glob("*")) - before
    assert [p.name for p in made.iterdir() if p.is_dir()] == [str(len(pipeline.STAGES) - 1)]


def test_line_rounds_release_the_driver(spark, monkeypatch):
    """Each round of the template tree has the driver collect what the round left."""
    rows = [(i, f"one two three {'ab'[i % 2]}x {'cd'[i // 2]}y {'ef'[i % 2]}z k{'lmno'[i]}") for i in range(4)]
    beans, turns, cut = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans, [], op5_lines.cut
    monkeypatch.setattr(op5_lines, "cut", lambda df, name="t": turns.append(name) or cut(df, name))
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    op5_lines.drops(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 1 <= turns.count("agreeing") <= full() - before
