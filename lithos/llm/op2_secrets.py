"""Secret scans over an incremental blob ledger.

Every version of a file is content-addressed; a blob is scanned once for each
rule version that the ledger has not seen, and findings are joined back to all
paths that hold the blob.  :func:`scan_history` does so for one version of a
corpus after the other and keeps ledger and findings as tables of the shared
folder.  Defined cases: null text is the empty blob; rows
that agree in id and text are one path each and get the same findings; an
empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sieve, text_of

FINDINGS = "array<struct<rule:string,version:int,start:int,end:int>>"


class Rule(NamedTuple):
    """A pattern, its version, words of which one must be there (lower case), and what a match must meet."""

    name: str
    version: int
    pattern: str
    needs: tuple[str, ...] = ()
    keep: Callable[[re.Match], bool] | None = None


BASE = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "apikey", "api_key"), lambda m: len(m[2]) >= 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), lambda m: m.end() - m.start() >= 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # maximal runs, so the same as all runs of 24 and more
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE + ADDED


def find(text: str, rules: tuple[Rule, ...], compiled: dict[str, re.Pattern] | None = None) -> list[tuple[str, int, int, int]]:
    """(rule, version, start, end) of every finding, by start, then in the rules' order."""
    low = text.lower()
    out = []
    for at, rule in enumerate(rules):
        if rule.needs and not any(x in low for x in rule.needs):
            continue
        for m in (compiled or {}).get(rule.name, re.compile(rule.pattern)).finditer(text):
            if rule.keep is None or rule.keep(m):
                out.append((m.start(), at, rule.name, rule.version, m.end()))
    return [(name, version, start, end) for start, _, name, version, end in sorted(out)]


def blobs(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, path key, blob) of each version; the blob is the SHA-256 of the bytes."""
    return versions.select(F.col(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000")).alias("_path"), F.unhex(F.sha2(text_of(text_col), 256)).alias("blob"))


def scan_unseen(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(blob, scanned: array of rule:version, findings) of each blob with unseen rule versions.

    ``ledger`` has (blob, rule, version) of what was scanned before.  One path
    of each blob, the least, lends its text; only keys are grouped, so a blob
    with many copies costs one row.
    """
    paths = blobs(versions, id_col, text_col)
    one = paths.groupBy("blob").agg(F.min("_path").alias("_path"))
    every = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        one = one.withColumn("_todo", F.explode(every)).select("blob", "_path", "_todo.rule", "_todo.version")
        one = one.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti").groupBy("blob", "_path").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("todo"))
        one = cut(one, "unseen")
    else:
        one = one.withColumn("todo", F.transform(every, lambda r: F.concat_ws(":", r["rule"], r["version"])))
    texts = versions.select(F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000")).alias("_path"), text_of(text_col).alias("_text"), F.unhex(F.sha2(text_of(text_col), 256)).alias("blob"))
    if ledger is not None:  # texts of blobs that were seen are not shuffled
        texts = sieve(texts, one, "_path", "blob")
    # the keys are built into hash tables, so the texts are shuffled once and never sorted
    picked = texts.join(one.hint("shuffle_hash"), ["_path", "blob"]).select("blob", "todo", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name: re.compile(r.pattern) for r in rules}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for todo, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                due = tuple(r for r in rules if f"{r.name}:{r.version}" in todo)
                found.append([dict(zip(("rule", "version", "start", "end"), x, strict=True)) for x in find(text, due, compiled)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["blob", "scanned", "findings"])

    return picked.mapInArrow(run, f"blob binary, scanned array<string>, findings {FINDINGS}")


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """What a scan adds to the ledger: (blob, rule, version)."""
    pair = F.split("pair", ":")
    return scanned.select("blob", F.explode("scanned").alias("pair")).select("blob", pair[0].alias("rule"), pair[1].cast("int").alias("version")).distinct()


def findings_rows(scanned: DataFrame) -> DataFrame:
    """What a scan adds to the store of findings: (blob, rule, version, start, end)."""
    return scanned.select("blob", F.explode("findings").alias("f")).select("blob", "f.*").distinct()


def by_path(versions: DataFrame, scanned: DataFrame | None, rules: tuple[Rule, ...] = RULES, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings) of every path: those just found and those in ``known``, in order of start."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.name}:{r.version}"), F.lit(i))])
    rows = known.select("blob", "rule", "version", "start", "end") if known is not None else None
    if scanned is not None:
        rows = findings_rows(scanned) if rows is None else rows.unionByName(findings_rows(scanned)).distinct()
    rows = rows.withColumn("_order", order[F.concat_ws(":", "rule", "version")]).where("_order IS NOT NULL")
    each = rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "_order", "rule", "version", "end"))).alias("findings"))
    joined = blobs(versions, id_col, text_col).join(each, "blob", "left")
    return joined.select(F.col(id_col), F.coalesce("findings", F.array().cast("array<struct<start:int,_order:int,rule:string,version:int,end:int>>")).alias("findings"))


class History(NamedTuple):
    """What the scans of the versions so far left: (blob, rule, version), their findings, and how many blobs each version had scanned."""

    ledger: DataFrame
    known: DataFrame
    scanned: tuple[int, ...]


def scan_history(versions: list[DataFrame], rules: tuple[Rule, ...] = RULES, before: History | None = None, id_col: str = "doc_id", text_col: str = "text") -> History:
    """Scans each version in turn; the ledger decides which blobs of a version are read."""
    for version in versions:
        done = cut(scan_unseen(version, rules, before.ledger if before else None, id_col, text_col), "scanned")
        ledger, known, counts = ledger_rows(done), findings_rows(done), (done.select("blob").distinct().count(),)
        if before:
            ledger, known, counts = before.ledger.unionByName(ledger), before.known.unionByName(known), before.scanned + counts
        before = History(cut(ledger, "ledger"), cut(known, "findings"), counts)
    return before
