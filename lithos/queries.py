"""The registered queries of the file-analysis operators, each with its SQL.

Signature stores, digests and evidence are derived from the given tables by
rules that SQL can repeat, so that nearly every query has an exact oracle.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import bloom, ctph, digests, filetype, tlsh
from lithos.functions.filetype_tables import EXPECTED, MAGIC, RUNNING_EXTENSIONS, RUNNING_TYPES
from lithos.functions.pe import entropy_column
from lithos.operators import lookup, packer, rules, serving, similarity, stores
from lithos.plans import scan
from lithos.schemas import DETECTION, PE
from lithos.sources import files
from lithos.sources.tables import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs derived from the tables -------------------------------------------------------------

_DOCS = "d AS (SELECT doc_id, text, strlen(text)::BIGINT AS size, md5(text) AS md5, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL)"
_SIZE = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN size ELSE size + doc_id % 2 END"
# every document gives an entry; only some of them are entries of the document's own digest
_SIGS = f"sigs AS (SELECT hash, first(sz ORDER BY doc_id) AS size, first(name ORDER BY doc_id) AS name, min(doc_id) AS seq FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN sha256 ELSE sha256(text || 'x') END AS hash, {_SIZE} AS sz, 'Known.' || doc_id AS name FROM d) GROUP BY hash)"
_MD5S = f"md5s AS (SELECT hash, min(doc_id) AS seq, first({_SIZE} ORDER BY doc_id) AS size, first('Md5.' || doc_id ORDER BY doc_id) AS name FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN md5 ELSE md5(text || 'x') END AS hash FROM d) GROUP BY hash)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return rows.withColumns({"size": F.octet_length("text").cast("bigint"), "md5": F.md5(F.encode("text", "UTF-8")), "sha256": F.sha2(F.encode("text", "UTF-8"), 256)})


def _size() -> F.Column:
    return F.when(F.col("doc_id") % 3 == 1, F.col("size")).when(F.col("doc_id") % 3 == 2, F.col("size") + F.col("doc_id") % 2)


def _sigs(docs: DataFrame, kind: str = "sha256", every: int = 7, prefix: str = "Known.") -> DataFrame:
    salted = F.encode(F.concat("text", F.lit("x")), "UTF-8")
    other = F.sha2(salted, 256) if kind == "sha256" else F.md5(salted)
    rows = docs.select(F.when(F.col("doc_id") % every == 0, F.col(kind)).otherwise(other).alias("hash"), F.col("doc_id").alias("seq"), _size().alias("size"), F.concat(F.lit(prefix), "doc_id").alias("name"))
    return stores.first_wins(rows, ["hash"]).select("hash", "size", "name", "seq")


_TLSH = """t AS (
  SELECT c.doc_id, c.size, upper(substr(p.sha256 || sha256(p.text || 'x'), 1, 20 + c.doc_id % 10) || substr(c.md5, 1, (c.doc_id % 4)::INT) || substr(substr(p.sha256 || sha256(p.text || 'x'), 1, 70), (21 + c.doc_id % 10 + c.doc_id % 4)::INT)) AS tlsh
  FROM d c JOIN d p ON p.doc_id = c.doc_id - c.doc_id % 5)"""


def _tlsh(docs: DataFrame) -> DataFrame:
    """TLSH-shaped digests: those of five documents in a row differ in a few digits."""
    p = docs.select((F.col("doc_id")).alias("parent"), F.substring(F.concat("sha256", F.sha2(F.encode(F.concat("text", F.lit("x")), "UTF-8"), 256)), 1, 70).alias("base"))
    c = docs.select("doc_id", "size", "md5", (F.col("doc_id") - F.col("doc_id") % 5).alias("parent")).join(p, "parent")
    at, n = (20 + F.col("doc_id") % 10).cast("int"), (F.col("doc_id") % 4).cast("int")
    return c.select("doc_id", "size", F.upper(F.concat(F.substring("base", F.lit(1), at), F.substring("md5", F.lit(1), n), F.substring("base", at + n + 1, F.lit(70)))).alias("tlsh"))


_SSDEEP = """s AS (
  SELECT c.doc_id, c.size, (3 * 2 ** (c.doc_id // 5 % 4))::BIGINT || ':' || substr(to_base64(unhex(p.sha256)), 1, (20 + c.doc_id % 20)::INT) || CASE WHEN c.doc_id % 3 = 0 THEN 'AAAAAA' ELSE substr(to_base64(unhex(c.md5)), 1, 8) END
     || ':' || substr(to_base64(unhex(p.md5)), 1, 20) AS ssdeep
  FROM d c JOIN d p ON p.doc_id = c.doc_id - c.doc_id % 5)"""


def _ssdeep(docs: DataFrame) -> DataFrame:
    """Digests in ssdeep form that share parts within five documents in a row."""
    p = docs.select(F.col("doc_id").alias("parent"), F.base64(F.unhex("sha256")).alias("p1"), F.base64(F.unhex("md5")).alias("p2"))
    c = docs.select("doc_id", "size", F.base64(F.unhex("md5")).alias("own"), (F.col("doc_id") - F.col("doc_id") % 5).alias("parent")).join(p, "parent")
    block = (3 * F.pow(F.lit(2), F.expr("doc_id div 5 % 4"))).cast("bigint")
    first = F.concat(F.substring("p1", F.lit(1), (20 + F.col("doc_id") % 20).cast("int")), F.when(F.col("doc_id") % 3 == 0, "AAAAAA").otherwise(F.substring("own", 1, 8)))
    return c.select("doc_id", "size", F.concat_ws(":", block, first, F.substring("p2", 1, 20)).alias("ssdeep"))


# --- digests, routing, counts ---------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL")
def digests_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.from_text(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return rows.select(F.col("sample_id").alias("doc_id"), *[c.alias(n) for n, c in digests.digests(F.col("content")).items()], F.octet_length("content").cast("bigint").alias("size"))


@query(f"WITH {_DOCS} SELECT doc_id, substr(sha256, 1, 2) AS shard FROM d")
def shard_route_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", digests.shard_hex(F.col("sha256")).alias("shard"))


@query(f"WITH {_DOCS} SELECT doc_id, lpad((('0x' || substr(sha256, 1, 8))::UBIGINT % 64)::VARCHAR, 4, '0') AS shard FROM d")
def shard_route_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", digests.shard_modulo(F.col("sha256"), 64).alias("shard"))


@query(f"WITH {_DOCS}, {_SIGS} SELECT substr(hash, 1, 2) AS shard, count(*) AS rows FROM sigs GROUP BY ROLLUP (shard)")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.counts(stores.with_shard(_sigs(_docs(spark, sf_dir))), "shard")


# --- ingest ------------------------------------------------------------------------------------------

_LINES = """l AS (SELECT doc_id AS seq, CASE doc_id % 11 WHEN 0 THEN '# note ' || doc_id WHEN 1 THEN '' WHEN 2 THEN md5 || ':' || size || ':Md5.' || doc_id WHEN 3 THEN sha256 || ':*:Any.' || doc_id
  WHEN 4 THEN 'zz' || substr(sha256, 3) || ':5:Bad' WHEN 5 THEN sha256 || ':0:Zero.' || doc_id WHEN 6 THEN 'short:1' WHEN 7 THEN sha256 || ':x1:NoSize' ELSE '  ' || upper(sha256) || ':' || size || ': Name.' || doc_id || ' ' END AS line FROM d)"""
_PARSED = """p AS (SELECT seq, lower(trim(f[1])) AS hash, trim(f[2]) AS sz, trim(f[3]) AS name, len(f) AS n FROM (SELECT seq, string_split(trim(line), ':') AS f FROM l WHERE trim(line) <> '' AND trim(line)[1] <> '#')),
h AS (SELECT seq, hash, CASE WHEN sz NOT IN ('*', '0') THEN try_cast(sz AS BIGINT) END AS size, name,
  CASE WHEN n < 3 THEN 'bad' WHEN length(hash) <> 64 AND length(hash) IN (32, 40) THEN 'skipped' WHEN length(hash) <> 64 OR NOT regexp_full_match(hash, '[0-9a-f]+') THEN 'bad' WHEN sz NOT IN ('*', '0') AND try_cast(sz AS BIGINT) IS NULL THEN 'size' ELSE 'ok' END AS status FROM p)"""


def _lines(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id") % 11
    line = (
        F.when(i == 0, F.concat(F.lit("# note "), "doc_id")).when(i == 1, "").when(i == 2, F.concat("md5", F.lit(":"), "size", F.lit(":Md5."), "doc_id")).when(i == 3, F.concat("sha256", F.lit(":*:Any."), "doc_id"))
        .when(i == 4, F.concat(F.lit("zz"), F.substring("sha256", 3, 64), F.lit(":5:Bad"))).when(i == 5, F.concat("sha256", F.lit(":0:Zero."), "doc_id")).when(i == 6, "short:1").when(i == 7, F.concat("sha256", F.lit(":x1:NoSize")))
        .otherwise(F.concat(F.lit("  "), F.upper("sha256"), F.lit(":"), "size", F.lit(": Name."), "doc_id", F.lit(" ")))
    )
    return docs.select(F.col("doc_id").alias("seq"), line.alias("value"))


@query(f"WITH {_DOCS}, {_LINES}, {_PARSED} SELECT hash, min(seq) AS seq, min_by(coalesce(size, -1), seq) AS size, min_by(name, seq) AS name FROM h WHERE status = 'ok' GROUP BY hash")
def hdb_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stores.parse_hdb(_lines(_docs(spark, sf_dir))).where("status = 'ok'").drop("status")
    return stores.first_wins(rows, ["hash"]).select("hash", "seq", F.coalesce("size", F.lit(-1)).alias("size"), "name")


@query(f"WITH {_DOCS}, {_LINES}, {_PARSED} SELECT status, count(*) AS lines FROM h GROUP BY status")
def hdb_skipped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.parse_hdb(_lines(_docs(spark, sf_dir))).groupBy("status").agg(F.count("*").alias("lines"))


_LINES8 = """l AS (SELECT doc_id AS seq, CASE doc_id % 9 WHEN 0 THEN '# x' WHEN 1 THEN sha256 || ':1:short' ELSE sha256 || ':' || CASE doc_id % 4 WHEN 0 THEN '*' ELSE size::VARCHAR END || ':Name.' || doc_id || ':3-abc' || doc_id || '-def:' || substr(md5, 1, (doc_id % 8)::INT) || ':' || sha256 || ': ' || md5 || ' :' || 'zz' END AS line FROM d),
f AS (SELECT seq, string_split(trim(line), ':') AS f FROM l WHERE trim(line)[1] <> '#')"""


def _lines8(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    size = F.when(i % 4 == 0, "*").otherwise(F.col("size").cast("string"))
    full = F.concat("sha256", F.lit(":"), size, F.lit(":Name."), "doc_id", F.lit(":3-abc"), "doc_id", F.lit("-def:"), F.substring("md5", F.lit(1), (i % 8).cast("int")), F.lit(":"), "sha256", F.lit(": "), "md5", F.lit(" :zz"))
    return docs.select(i.alias("seq"), F.when(i % 9 == 0, "# x").when(i % 9 == 1, F.concat("sha256", F.lit(":1:short"))).otherwise(full).alias("value"))


_UNPIVOT = """u AS (SELECT seq, k AS fuzzy_type, lower(trim(f[i])) AS value, CASE WHEN f[2] NOT IN ('*', '0') THEN try_cast(f[2] AS BIGINT) END AS size, trim(f[3]) AS name, f[1] AS sha256
  FROM f, (VALUES ('vhash', 5), ('authentihash', 6), ('imphash', 7), ('rich_header_hash', 8)) v(k, i) WHERE len(f) >= 8 AND regexp_full_match(lower(trim(f[i])), '([0-9a-f]{2})+'))"""


@query(f"WITH {_DOCS}, {_LINES8}, {_UNPIVOT} SELECT * FROM u")
def hdb8_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.parse_hdb8(_lines8(_docs(spark, sf_dir)))


@query(f"WITH {_DOCS}, {_LINES8}, {_UNPIVOT} SELECT fuzzy_type, count(*) AS rows FROM (SELECT DISTINCT fuzzy_type, value FROM u) GROUP BY ROLLUP (fuzzy_type)")
def fuzzy_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stores.parse_hdb8(_lines8(_docs(spark, sf_dir)))
    return stores.counts(stores.first_wins(rows, ["fuzzy_type", "value"]), "fuzzy_type")


@query(f"WITH {_DOCS}, {_LINES8} SELECT seq, array_to_string(string_split(f[4], '-')[1:3], ':') AS ssdeep, CASE WHEN f[2] NOT IN ('*', '0') THEN try_cast(f[2] AS BIGINT) END AS size, f[3] AS name, f[1] AS sha256 FROM f WHERE len(f) >= 8")
def ssdeep_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.parse_ssdeep8(_lines8(_docs(spark, sf_dir)))


@query("SELECT sha256('1:' || i) AS hash, 100 + i % 900 AS size, printf('Test.Gen.1.%09d', i) AS name FROM (SELECT unnest(range((SELECT 5 * count(*) FROM documents))) AS i)")
def synthetic_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.generated(spark, 5 * table(spark, sf_dir, "documents").count())


# --- changes of stores -----------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT md5 AS hash, min(doc_id) AS seq, min_by(size, doc_id) AS size FROM d GROUP BY md5")
def sig_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.first_wins(_docs(spark, sf_dir).select(F.col("md5").alias("hash"), F.col("doc_id").alias("seq"), "size"), ["hash"])


@query(f"WITH {_DOCS}, {_SIGS} SELECT hash, seq, name FROM sigs UNION ALL SELECT sha256, min(doc_id), 'Added.' || min(doc_id) FROM d WHERE sha256 NOT IN (SELECT hash FROM sigs) GROUP BY sha256")
def sig_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    new = docs.select(F.col("sha256").alias("hash"), F.col("doc_id").alias("seq"), F.concat(F.lit("Added."), "doc_id").alias("name"))
    return stores.add(_sigs(docs).select("hash", "seq", "name"), new, ["hash"])


@query(f"WITH {_DOCS}, {_SIGS} SELECT hash, name FROM sigs WHERE hash NOT IN (SELECT CASE WHEN doc_id % 2 = 0 THEN sha256 ELSE md5 END FROM d)")
def sig_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return stores.delete(_sigs(docs).select("hash", "name"), docs.select(F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).otherwise(F.col("md5")).alias("hash")), ["hash"])


@query(f"WITH {_DOCS}, {_SIGS} SELECT hash, lpad((('0x' || substr(hash, 1, 8))::UBIGINT % 16)::VARCHAR, 4, '0') AS shard FROM sigs")
def reshard_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = stores.with_shard(_sigs(_docs(spark, sf_dir)), "hex")
    return stores.with_shard(sigs, "modulo", 16).select("hash", "shard")


@query("SELECT 'f' || doc_id AS name FROM documents WHERE doc_id % 4 <> 0")
def import_registry_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("name"))
    registry = names.select(F.concat(F.when(F.col("doc_id") % 4 == 0, "f").otherwise("g"), "doc_id").alias("name"))
    return stores.not_imported(names.select("name"), registry)


# --- lookups ------------------------------------------------------------------------------------------


@query(f"WITH {_DOCS}, {_SIGS} SELECT doc_id, name FROM d JOIN sigs ON sha256 = hash AND (sigs.size IS NULL OR sigs.size = d.size)")
def lookup_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return lookup.exact(docs, _sigs(docs), "sha256").select("doc_id", F.col("sig_name").alias("name"))


@query(f"WITH {_DOCS}, {_MD5S} SELECT doc_id, name FROM d JOIN md5s ON md5 = hash AND (md5s.size IS NULL OR md5s.size = d.size)")
def lookup_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return lookup.exact(docs, _sigs(docs, "md5", 5, "Md5."), "md5").select("doc_id", F.col("sig_name").alias("name"))


@query(
    f"WITH {_DOCS}, {_SIGS}, {_MD5S}, v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || upper(sha256) WHEN 1 THEN md5 WHEN 2 THEN sha256 ELSE 'x' || md5 END AS value FROM d) "
    "SELECT value, CASE WHEN regexp_full_match(lower(trim(value)), '[0-9a-f]{64}') THEN 'sha256' WHEN regexp_full_match(lower(trim(value)), '[0-9a-f]{32}') THEN 'md5' ELSE 'invalid' END AS kind, coalesce(sigs.name, md5s.name) AS name "
    "FROM v LEFT JOIN sigs ON sigs.hash = lower(trim(value)) LEFT JOIN md5s ON md5s.hash = lower(trim(value))"
)
def lookup_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    i = F.col("doc_id") % 4
    value = F.when(i == 0, F.concat(F.lit(" "), F.upper("sha256"))).when(i == 1, F.col("md5")).when(i == 2, F.col("sha256")).otherwise(F.concat(F.lit("x"), "md5"))
    return lookup.routed(docs.select(value.alias("value")), _sigs(docs), _sigs(docs, "md5", 5, "Md5."))


@query(
    f"WITH {_DOCS}, {_LINES8}, {_UNPIVOT}, fz AS (SELECT fuzzy_type, value, min_by(coalesce(size, -1), seq) AS size, min_by(name, seq) AS name FROM u GROUP BY ALL) "
    "SELECT doc_id, fuzzy_type, name FROM d JOIN fz ON value = CASE fuzzy_type WHEN 'imphash' THEN d.md5 WHEN 'authentihash' THEN d.sha256 END WHERE fz.size = -1 OR fz.size = d.size"
)
def lookup_fuzzy_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    store = stores.first_wins(stores.parse_hdb8(_lines8(docs)), ["fuzzy_type", "value"])
    return lookup.computed(docs.select("doc_id", "size", F.col("md5").alias("imphash"), F.col("sha256").alias("authentihash")), store, "doc_id").select("doc_id", "fuzzy_type", F.col("sig_name").alias("name"))


@query(f"WITH {_DOCS}, {_TLSH} SELECT a.doc_id, b.doc_id AS entry FROM t a JOIN t b ON a.tlsh = b.tlsh")
def lookup_tlsh_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tlsh(_docs(spark, sf_dir))
    probes = t.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lower("tlsh")).otherwise(F.concat(F.lit("T1"), "tlsh")).alias("value"))
    return lookup.tlsh_exact(probes, t.select("tlsh", F.col("doc_id").alias("name"))).select("doc_id", F.col("sig_name").alias("entry"))


@query(f"WITH {_DOCS}, {_SSDEEP} SELECT a.doc_id, b.doc_id AS entry FROM s a JOIN s b ON b.ssdeep = CASE WHEN a.doc_id % 4 = 0 THEN replace(a.ssdeep, ':', '-') ELSE a.ssdeep END WHERE a.size = b.size")
def lookup_ssdeep_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _ssdeep(_docs(spark, sf_dir))
    probes = s.select("doc_id", "size", F.when(F.col("doc_id") % 4 == 0, F.replace("ssdeep", F.lit(":"), F.lit("-"))).otherwise(F.col("ssdeep")).alias("value"))
    return lookup.ssdeep_exact(probes, s.select("ssdeep", "size", F.col("doc_id").alias("name"))).select("doc_id", F.col("sig_name").alias("entry"))


# --- TLSH -----------------------------------------------------------------------------------------------

_HEADER = "x AS (SELECT *, ('0x' || tlsh[4] || tlsh[3])::INT AS lv, ('0x' || tlsh[5])::INT AS q1, ('0x' || tlsh[6])::INT AS q2 FROM t)"
_M = "[" + ", ".join(str(tlsh.CODE_DISTANCE[a & 3][b & 3] + tlsh.CODE_DISTANCE[a >> 2][b >> 2]) for a in range(16) for b in range(16)) + "]"


def _circle(a: str, b: str, n: int) -> str:
    return f"least(abs({a} - {b}), {n} - abs({a} - {b}))"


def _distance(a: str, b: str) -> str:
    q = " + ".join(f"CASE WHEN {_circle(f'{a}.{c}', f'{b}.{c}', 16)} <= 1 THEN {_circle(f'{a}.{c}', f'{b}.{c}', 16)} ELSE ({_circle(f'{a}.{c}', f'{b}.{c}', 16)} - 1) * 12 END" for c in ("q1", "q2"))
    l = _circle(f"{a}.lv", f"{b}.lv", 256)  # noqa: E741
    body = f"list_sum(list_transform(range(7, 71), lambda i: {_M}[('0x' || {a}.tlsh[i])::INT * 16 + ('0x' || {b}.tlsh[i])::INT + 1]))"
    return f"((CASE WHEN {a}.tlsh[1:2] <> {b}.tlsh[1:2] THEN 1 ELSE 0 END) + (CASE WHEN {l} <= 1 THEN {l} ELSE {l} * 12 END) + {q} + {body})::INT"


_PRUNE = f"{_circle('a.lv', 'b.lv', 256)} <= 3 AND {_circle('a.q1', 'b.q1', 16)} <= 4 AND {_circle('a.q2', 'b.q2', 16)} <= 4 AND a.tlsh <> b.tlsh"
_PAIRS = f"pairs AS (SELECT a.doc_id, b.doc_id AS entry, b.tlsh AS e, {_distance('a', 'b')} AS distance FROM x a JOIN x b ON {_PRUNE})"


@query(f"WITH {_DOCS}, {_TLSH}, {_HEADER} SELECT doc_id, lv, q1, q2 FROM x")
def tlsh_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tlsh(_docs(spark, sf_dir))
    return t.select("doc_id", *[c.alias(n) for n, c in tlsh.header(F.col("tlsh")).items()])


@query(f"WITH {_DOCS}, {_TLSH}, {_HEADER} SELECT a.doc_id, {_distance('a', 'b')} AS distance FROM x a JOIN x b ON b.doc_id = a.doc_id + 1")
def tlsh_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tlsh(_docs(spark, sf_dir)).select("doc_id", "tlsh")
    nxt = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("tlsh").alias("other"))
    return t.join(nxt, "doc_id").select("doc_id", tlsh.distance(F.col("tlsh"), F.col("other")).alias("distance"))


@query(f"WITH {_DOCS}, {_TLSH}, {_HEADER} SELECT a.doc_id, b.doc_id AS entry FROM x a JOIN x b ON {_PRUNE}")
def tlsh_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tlsh(_docs(spark, sf_dir)).select("doc_id", "tlsh")
    return similarity.tlsh_candidates(t, t).select("doc_id", F.col("e_doc_id").alias("entry"))


@query(f"WITH {_DOCS}, {_TLSH}, {_HEADER}, {_PAIRS} SELECT doc_id, e AS entry_tlsh, distance FROM pairs WHERE distance <= 40 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, e) <= 10")
def tlsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = written(_tlsh(_docs(spark, sf_dir)).select("doc_id", "tlsh"))
    return similarity.tlsh_top(t, t, "doc_id").select("doc_id", F.col("e_tlsh").alias("entry_tlsh"), "distance")


@query(f"WITH {_DOCS}, {_TLSH}, {_HEADER}, {_PAIRS} SELECT doc_id, entry, distance FROM pairs WHERE entry < doc_id AND distance <= 100 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, e, entry) <= 1000".replace("<= 3 AND", "<= 8 AND").replace("<= 4 AND", "<= 9 AND"))
def library_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = written(_tlsh(_docs(spark, sf_dir)).select("doc_id", "tlsh", F.col("doc_id").alias("seq")))
    return similarity.tlsh_replay(t, t, "doc_id", 100, 1000).select("doc_id", F.col("e_doc_id").alias("entry"), "distance")


@query()
def tlsh_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tlsh.digest_column(F.encode("text", "UTF-8")).alias("tlsh"))


@query()
def tlsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts, joined: near copies among all documents."""
    t = written(tlsh_digest(spark, sf_dir)).where("tlsh IS NOT NULL")  # each text is digested once
    return similarity.tlsh_top(t, t, "doc_id").select("doc_id", F.col("e_doc_id").alias("entry"), "distance")


# --- piecewise hashes ------------------------------------------------------------------------------------

_STRIP = "array_to_string(list_transform(list_filter(range(1, length({0}) + 1), lambda i: i <= 3 OR NOT ({0}[i] = {0}[i-1] AND {0}[i] = {0}[i-2] AND {0}[i] = {0}[i-3])), lambda i: {0}[i]), '')"
_GRAMS = "CASE WHEN length({0}) >= 7 AND regexp_full_match({0}, '[A-Za-z0-9+/]+') THEN list_distinct(list_transform(range(1, length({0}) - 5), lambda i: {0}[i:i+6])) ELSE [] END"
_PARTS = f"""y AS (SELECT doc_id, size, ssdeep, split_part(ssdeep, ':', 1)::BIGINT AS b, {_STRIP.format("split_part(ssdeep, ':', 2)")} AS h1, {_STRIP.format("split_part(ssdeep, ':', 3)")} AS h2 FROM s),
g AS (SELECT *, {_GRAMS.format("h1")} AS g1, {_GRAMS.format("h2")} AS g2 FROM y),
pg AS (SELECT doc_id, size, ssdeep, b, unnest(list_distinct(g1 || g2)) AS gram FROM g UNION ALL SELECT doc_id, size, ssdeep, b // 2, unnest(g1) FROM g UNION ALL SELECT doc_id, size, ssdeep, b * 2, unnest(g2) FROM g),
eg AS (SELECT doc_id, size, ssdeep, b, unnest(list_distinct(g1 || g2)) AS gram FROM g)"""


@query(f"WITH {_DOCS}, {_SSDEEP} SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE ssdeep END AS ssdeep FROM s")
def ssdeep_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 5
    given = F.when(i == 0, F.replace("ssdeep", F.lit(":"), F.lit("-"))).when(i == 4, F.concat(F.lit("x"), "ssdeep")).when(i == 3, F.concat("ssdeep", F.lit(":more"))).otherwise(F.col("ssdeep"))
    return _ssdeep(_docs(spark, sf_dir)).select("doc_id", ctph.normal(given).alias("ssdeep"))


@query(f"WITH {_DOCS}, {_SSDEEP}, {_PARTS} SELECT doc_id, b AS blocksize, h1, h2 FROM y")
def ssdeep_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("ssdeep")
    return _ssdeep(_docs(spark, sf_dir)).select("doc_id", ctph.block_size(s).alias("blocksize"), ctph.strip_runs(ctph.part(s, 1)).alias("h1"), ctph.strip_runs(ctph.part(s, 2)).alias("h2"))


@query(f"WITH {_DOCS}, {_SSDEEP}, {_PARTS} SELECT doc_id, b AS blocksize, gram, list_reduce(list_transform(range(1, 8), lambda i: (strpos('{ctph.ALPHABET}', gram[i]) - 1)::BIGINT), lambda t, c: t * 64 + c) AS code FROM eg")
def ssdeep_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similarity.entry_grams(_ssdeep(_docs(spark, sf_dir)))
    return rows.select(F.col("e_doc_id").alias("doc_id"), "blocksize", "gram", ctph.gram_code(F.col("gram")).alias("code"))


@query(f"WITH {_DOCS}, {_SSDEEP}, {_PARTS} SELECT b AS blocksize, gram, count(*) AS entries FROM eg GROUP BY ALL")
def gram_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.gram_rarity(_ssdeep(_docs(spark, sf_dir)))


@query(f"WITH {_DOCS}, {_SSDEEP}, {_PARTS} SELECT DISTINCT p.doc_id, e.doc_id AS entry FROM pg p JOIN eg e ON p.b = e.b AND p.gram = e.gram AND p.b > 0 WHERE p.ssdeep <> e.ssdeep AND e.size BETWEEN p.size // 2 AND p.size * 2")
def ssdeep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _ssdeep(_docs(spark, sf_dir))
    return similarity.ssdeep_candidates(s, s, "doc_id", "doc_id").select("doc_id", F.col("e_doc_id").alias("entry"))


@query()
def ssdeep_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", ctph.digest_column(F.encode("text", "UTF-8")).alias("ssdeep"))


@query()
def ssdeep_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = written(_docs(spark, sf_dir).select("doc_id", "size", ctph.digest_column(F.encode("text", "UTF-8")).alias("ssdeep"))).where("ssdeep IS NOT NULL")
    return similarity.ssdeep_top(s, s, "doc_id", "doc_id").select("doc_id", F.col("e_doc_id").alias("entry"), "score")


# --- growing libraries ------------------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT md5 AS key, min(doc_id) AS seq, max_by(size, doc_id) AS size, max_by('n' || doc_id, doc_id) AS name FROM d GROUP BY md5")
def library_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("md5").alias("key"), F.col("doc_id").alias("seq"), "size", F.concat(F.lit("n"), "doc_id").alias("name"))
    first, second = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    # the second upsert meets keys of the first; newest means the larger seq of either
    return stores.upsert(first, second, "key", ["size", "name"])


@query(f"WITH {_DOCS}, {_SSDEEP}, {_PARTS} SELECT gram, b AS blocksize, doc_id AS entry FROM eg WHERE doc_id IN (SELECT doc_id FROM s ORDER BY doc_id DESC LIMIT 300)")
def library_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _ssdeep(_docs(spark, sf_dir)).withColumnRenamed("doc_id", "seq")
    return stores.without_orphans(stores.gram_index(s), stores.keep_newest(s, 300)).select("gram", "blocksize", "entry")


# --- filters ----------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT greatest(n_chars, 1)::DOUBLE AS n, doc_id FROM documents), m AS (SELECT doc_id, n, ceil(-(n * ln(0.01)) / ln(2) ** 2) AS m FROM n) SELECT doc_id, m::BIGINT AS bits, least(greatest(round_even(m / n * ln(2), 0)::INT, 1), 16) AS hashes FROM m")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits, hashes = digests.bloom_size(F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", bits.cast("bigint").alias("bits"), hashes.alias("hashes"))


@query()
def bloom_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = stores.with_shard(_sigs(_docs(spark, sf_dir)))
    return bloom.build(sigs, "hash", "shard")


# --- file types --------------------------------------------------------------------------------------------

_HEX = "hex(encode({0}))"
_TEXT_TYPE = """CASE WHEN n = 0 THEN 'CL_TYPE_ANY' WHEN n > 1024 AND substr(hx, 2049, 1) IN ('8', '9', 'A', 'B') THEN 'CL_TYPE_BINARY_DATA'
  WHEN substr(hx, 1, 1) < '8' AND len(list_filter(range(0, least(n, 1024)), lambda i: (substr(hx, 2 * i + 1, 2) BETWEEN '20' AND '7E') OR substr(hx, 2 * i + 1, 2) IN ('09', '0A', '0D'))) > least(n, 1024) * 0.90 THEN 'CL_TYPE_TEXT_ASCII' ELSE 'CL_TYPE_TEXT_UTF8' END"""
_MAGIC_CASE = " ".join(f"WHEN substr(hx, {2 * o + 1}, {2 * len(m)}) = '{m.hex().upper()}' THEN '{code}'" for o, m, _, code, _ in MAGIC)
_HTML = r"regexp_matches(t, '(?i)<(html|head|script|iframe|img|object|table|a\s[^>]*href|!DOCTYPE|body)\b')"


@query(f"WITH b AS (SELECT doc_id, text, strlen(text)::BIGINT AS n, {_HEX.format('text')} AS hx FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_TEXT_TYPE} AS cl_type FROM b")
def filetype_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", filetype.text_type(filetype.head(F.encode("text", "UTF-8")))["cl_type"].alias("cl_type"))


@query(f"WITH b AS (SELECT page_id, strlen(html)::BIGINT AS n, {_HEX.format('html')} AS hx, substr(html, 1, 1024) AS t FROM pages WHERE html IS NOT NULL) SELECT page_id, CASE {_MAGIC_CASE} WHEN {_HTML} THEN 'CL_TYPE_HTML' ELSE {_TEXT_TYPE} END AS cl_type FROM b")
def filetype_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    return pages.select("page_id", filetype.file_type(F.encode("html", "UTF-8"))["cl_type"].alias("cl_type"))


_MAGICS = ", ".join(f"({i}, '{('20' * o + m.hex()).upper()}')" for i, (o, m, *_) in enumerate(MAGIC))


@query(f"WITH b AS (SELECT doc_id, v.h || {_HEX.format('text')} AS hx FROM documents, (VALUES {_MAGICS}) v(i, h) WHERE doc_id % {len(MAGIC)} = v.i AND text IS NOT NULL) SELECT doc_id, CASE {_MAGIC_CASE} END AS cl_type FROM b")
def filetype_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.createDataFrame([(i, bytes(b" " * o + m)) for i, (o, m, *_) in enumerate(MAGIC)], "i int, start binary")
    docs = _docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % len(MAGIC)).alias("i"), F.encode("text", "UTF-8").alias("rest"))
    # what starts like a ZIP stays one here: its entries are not read
    return docs.join(F.broadcast(starts), "i").select("doc_id", filetype.file_type(F.concat("start", "rest"))["cl_type"].alias("cl_type"))


_EXTS = ["txt", "pdf", "html", "exe", "png", "tar.gz", "htm", "jar"]
_NAME = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN 'file{e and '.'}{e}'" for i, e in enumerate(_EXTS)) + " ELSE '.html' END"


def _filename() -> F.Column:
    i = F.col("page_id") % 9
    out = F.when(i == 0, f"file.{_EXTS[0]}")
    for k, e in enumerate(_EXTS[1:], 1):
        out = out.when(i == k, f"file.{e}")
    return out.otherwise(".html")


_EXPECTED = "MAP {" + ", ".join(f"'{e}': [{', '.join(f"'{t}'" for t in ts)}]" for e, ts in EXPECTED.items()) + "}"
_TYPED = f"""b AS (SELECT page_id, {_NAME} AS fname, CASE WHEN page_id % 3 = 0 THEN 'FWS' || html ELSE html END AS html FROM pages WHERE html IS NOT NULL),
c AS (SELECT page_id, fname, strlen(html)::BIGINT AS n, {_HEX.format('html')} AS hx, substr(html, 1, 1024) AS t, CASE WHEN fname[1] = '.' THEN '' ELSE regexp_extract(fname, '\\.[^.]*$') END AS ext FROM b),
e AS (SELECT page_id, ext, CASE {_MAGIC_CASE} WHEN {_HTML} THEN 'CL_TYPE_HTML' ELSE {_TEXT_TYPE} END AS cl_type FROM c),
m AS (SELECT page_id, cl_type, ext, {_EXPECTED}[ext] AS wanted FROM e),
w AS (SELECT page_id, cl_type, CASE WHEN wanted IS NULL OR list_contains(wanted, cl_type) THEN NULL WHEN cl_type IN {RUNNING_TYPES} AND ext NOT IN {RUNNING_EXTENSIONS} THEN 'disguise' ELSE 'mismatch' END AS kind FROM m)"""


def _typed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("FWS"), "html")).otherwise(F.col("html"))
    return filetype.refined(pages.select("page_id", _filename().alias("filename"), F.encode(html, "UTF-8").alias("content")))


@query(f"WITH {_TYPED} SELECT page_id, kind FROM w")
def ext_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filetype.mismatch(F.col("filename"), F.col("file_type"))
    return _typed_pages(spark, sf_dir).select("page_id", F.when(F.contains(found, F.lit("疑似伪装")), "disguise").when(found.isNotNull(), "mismatch").alias("kind"))


@query(f"WITH {_TYPED} SELECT page_id, (kind IS NOT NULL)::INT AS n_signals, CASE WHEN kind IS NOT NULL THEN 'FileType/suspicious/扩展名与内容不一致' ELSE '' END AS signals FROM w")
def type_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filetype.signals(F.col("filename"), F.col("file_type"))
    return _typed_pages(spark, sf_dir).select("page_id", F.size(found).alias("n_signals"), F.array_join(F.transform(found, lambda s: F.concat_ws("/", s["engine"], s["type"], s["name"])), ",").alias("signals"))


@query(
    "WITH b AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, n, substr(hx, 2 * i + 1, 2) AS x, count(*) AS c FROM (SELECT doc_id, n, hx, unnest(range(0, n)) AS i FROM b) GROUP BY ALL) "
    "SELECT b.doc_id, round(coalesce(e, 0), 6) AS entropy FROM b LEFT JOIN (SELECT doc_id, -sum(c / n * log2(c / n)) AS e FROM c GROUP BY doc_id) USING (doc_id)"
)
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(entropy_column(F.encode("text", "UTF-8")), 6).alias("entropy"))


# --- rules and packers --------------------------------------------------------------------------------------

RULES = r"""
rule Boilerplate { meta: severity = "low" strings: $a = "all rights reserved" nocase $b = "Licensed under" ascii wide condition: any of them }
rule Credential { meta: severity = "high" weight = 3 strings: $p = "password=" $k = { 41 4B 49 41 ?? ?? } condition: $p or $k }
rule TwoOf { strings: $a = "MIT License" $b = "Released" $c = "under the" condition: 2 of ($a, $b, $c) }
rule Contact { strings: $at = "@mail" $com = "example.com" nocase condition: all of ($at, $com) and (not uint16(0) == 0x5A4D) }
"""
_MATCHED = """m AS (SELECT doc_id, text, CASE WHEN contains(lower(text), 'all rights reserved') OR contains(text, 'Licensed under') THEN 'Boilerplate' END AS r1, CASE WHEN contains(text, 'password=') OR regexp_matches(text, '(?s)AKIA..') THEN 'Credential' END AS r2,
  CASE WHEN contains(text, 'MIT License')::INT + contains(text, 'Released')::INT + contains(text, 'under the')::INT >= 2 THEN 'TwoOf' END AS r3, CASE WHEN contains(text, '@mail') AND contains(lower(text), 'example.com') AND text[1:2] <> 'MZ' THEN 'Contact' END AS r4 FROM documents WHERE text IS NOT NULL)"""


@query(f"WITH {_MATCHED} SELECT doc_id, concat_ws(',', r1, r2, r3, r4) AS rules, list_count([r1, r2, r3, r4])::INT AS n_rules FROM m")
def yara_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = files.from_text(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")
    hits = rules.scan(samples, rules.parse(RULES))
    return hits.select(F.col("sample_id").alias("doc_id"), F.array_join(F.transform("rule_hits", lambda h: h["rule"]), ",").alias("rules"), F.size("rule_hits").alias("n_rules"))


_EVIDENCE = "ev AS (SELECT l_orderkey AS sample_id, 'F' || l_partkey % 7 AS family, (1 + l_linenumber % 3)::INT AS weight FROM lineitem WHERE l_orderkey % 5 = 0), hv AS (SELECT l_orderkey AS sample_id, CASE WHEN l_quantity > 25 THEN 15 ELSE 10 END AS weight FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber = 1)"


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    ev = rows.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("sample_id"), F.concat(F.lit("F"), F.col("l_partkey") % 7).alias("family"), (1 + F.col("l_linenumber") % 3).cast("int").alias("weight"))
    hv = rows.where("l_orderkey % 5 <> 0 OR l_linenumber = 1").select(F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_quantity") > 25, 15).otherwise(10).alias("weight"))
    return ev, hv


_FAMILY = f"{_EVIDENCE}, fam AS (SELECT sample_id, family, sum(weight)::INT AS weight, least(60, 20 + (sum(weight)::INT - 1) * 12) AS score, CASE WHEN sum(weight) >= 3 THEN 'high' WHEN sum(weight) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM ev GROUP BY ALL)"


@query(f"WITH {_FAMILY} SELECT * FROM fam")
def packer_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packer.families(_evidence(spark, sf_dir)[0])


@query(
    f"WITH {_FAMILY}, ex AS (SELECT sample_id, sum(score) AS ex, max(CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS lv, string_agg(family, ',' ORDER BY weight DESC, family) AS packers FROM fam GROUP BY sample_id), "
    "hu AS (SELECT sample_id, least(40, sum(weight))::INT AS heu FROM hv GROUP BY sample_id), j AS (SELECT coalesce(ex.sample_id, hu.sample_id) AS sample_id, ex, lv, packers, coalesce(heu, 0) AS heu FROM ex FULL JOIN hu ON ex.sample_id = hu.sample_id), "
    "k AS (SELECT *, least(100, least(60, coalesce(ex, 0)) + heu)::INT AS packed_score FROM j) "
    "SELECT sample_id, packed_score, (ex IS NOT NULL OR heu >= 35) AS detected, CASE WHEN ex IS NOT NULL AND (lv = 2 OR packed_score >= 65) THEN 'high' WHEN ex IS NOT NULL AND lv = 1 THEN 'medium' WHEN ex IS NOT NULL THEN 'low' WHEN heu >= 35 THEN 'medium' END AS confidence, "
    "CASE WHEN ex IS NOT NULL THEN packers WHEN heu >= 35 THEN 'Unknown (启发式)' ELSE '' END AS packers FROM k"
)
def packer_family_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packer.fuse(*_evidence(spark, sf_dir))
    return out.select("sample_id", "packed_score", "detected", "confidence", F.array_join("packers", ",").alias("packers"))


# --- reports -------------------------------------------------------------------------------------------------

_FNAME = "CASE doc_id % 5 WHEN 0 THEN 'f.txt' WHEN 1 THEN 'f.pdf' WHEN 2 THEN 'f.html' WHEN 3 THEN 'f.exe' ELSE 'noext' END"
_REPORT = f"""{_DOCS}, {_SIGS}, {_MD5S}, {_MATCHED},
r AS (SELECT d.doc_id, d.size, {_FNAME.replace("doc_id", "d.doc_id")} AS fname, sigs.name AS n1, md5s.name AS n2, CASE WHEN d.doc_id % 5 IN (1, 2, 3) THEN '扩展名与内容不一致' END AS n3, r1, r2, r3, r4
  FROM d LEFT JOIN sigs ON sigs.hash = d.sha256 AND (sigs.size IS NULL OR sigs.size = d.size) LEFT JOIN md5s ON md5s.hash = d.md5 AND (md5s.size IS NULL OR md5s.size = d.size) JOIN m ON m.doc_id = d.doc_id)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    i = F.col("doc_id") % 5
    name = F.when(i == 0, "f.txt").when(i == 1, "f.pdf").when(i == 2, "f.html").when(i == 3, "f.exe").otherwise("noext")
    samples = docs.select(F.col("doc_id").alias("sample_id"), name.alias("filename"), F.encode("text", "UTF-8").alias("content"))
    return scan.report(samples, _sigs(docs), _sigs(docs, "md5", 5, "Md5."), rules.parse(RULES))


@query(f"WITH {_REPORT} SELECT doc_id, fname AS filename, size, concat_ws(',', n1, n2, n3, r1, r2, r3, r4) AS names, list_count([n1, n2, n3, r1, r2, r3, r4])::INT AS n_detections, concat_ws(',', 'SHA256 Hash DB', 'MD5 Hash DB', CASE WHEN n3 IS NOT NULL THEN 'FileType Analysis' END, 'YARA') AS scanners FROM r")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.transform("detections", lambda d: d["name"]), ",")
    return _report(spark, sf_dir).select(F.col("sample_id").alias("doc_id"), "filename", "size", names.alias("names"), F.size("detections").alias("n_detections"), F.array_join("scanners", ",").alias("scanners"))


@query(f"WITH {_REPORT} SELECT CASE WHEN list_count([n1, n2, n3, r1, r2, r3, r4]) = 0 THEN 'CLEAN' ELSE 'DETECTED' END AS verdict, count(*) AS samples, sum(size)::BIGINT AS bytes FROM r GROUP BY verdict")
def scan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("samples"), F.sum("size").alias("bytes"))


_DEEP = f"""{_DOCS}, {_MATCHED}, {_LINES8}, {_UNPIVOT}, {_TLSH}, {_HEADER}, {_SSDEEP}, fz AS (SELECT fuzzy_type, value, first(size ORDER BY seq) AS size FROM u GROUP BY ALL),
nf AS (SELECT doc_id, string_agg(fuzzy_type, ',' ORDER BY CASE fuzzy_type WHEN 'imphash' THEN 0 ELSE 1 END) AS fuzzy FROM d JOIN fz ON value = CASE fuzzy_type WHEN 'imphash' THEN d.md5 WHEN 'authentihash' THEN d.sha256 END WHERE fz.size IS NULL OR fz.size = d.size GROUP BY doc_id),
sl AS (SELECT ssdeep, first(size ORDER BY doc_id) AS size, min(doc_id) AS seq FROM s GROUP BY ssdeep), ns AS (SELECT doc_id, 'Lib.' || seq AS same FROM s JOIN sl ON sl.ssdeep = s.ssdeep AND sl.size = s.size),
tl AS (SELECT tlsh, lv, q1, q2, min(doc_id) AS seq FROM x GROUP BY ALL), near AS (SELECT a.doc_id, 'Lib.' || b.seq AS name, {_distance('a', 'b')} AS distance, b.tlsh FROM x a JOIN tl b ON {_PRUNE}),
nt AS (SELECT doc_id, string_agg(name || '=' || distance, ',' ORDER BY distance, tlsh) AS near FROM (SELECT * FROM near WHERE distance <= 40 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, tlsh) <= 10) GROUP BY doc_id)"""


@query(f"WITH {_DEEP} SELECT m.doc_id, concat_ws(',', r1, r2, r3, r4) AS rules, coalesce(fuzzy, '') AS fuzzy, coalesce(same, '') AS same, coalesce(near, '') AS near, 'YARA,SSDeep Hash DB,TLSH Hash DB' AS scanners FROM m LEFT JOIN nf USING (doc_id) LEFT JOIN ns USING (doc_id) LEFT JOIN nt USING (doc_id)")
def scan_phase2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second phase over given digests; similar piecewise hashes, which SQL cannot score, are tested apart."""
    docs = _docs(spark, sf_dir)
    found = rules.scan(docs.withColumn("content", F.encode("text", "UTF-8")), rules.parse(RULES)).select("doc_id", "rule_hits", F.col("md5").alias("imphash"), F.col("sha256").alias("authentihash"))
    t, s = _tlsh(docs).select("doc_id", "tlsh"), _ssdeep(docs)
    null = lambda kind: F.lit(None).cast(kind)
    none = {"notes": F.array().cast("array<string>"), "pe": null(PE), "evidence": null(f"array<{packer.EVIDENCE}>"), "heuristics": null("array<struct<key:string,weight:int>>")}
    slim = written(found.join(t, "doc_id").join(s, "doc_id").withColumns(none))
    entry = lambda rows, kind: stores.first_wins(rows.select(kind, F.col("doc_id").alias("seq"), "size"), [kind]).select(kind, "seq", "size", F.concat(F.lit("Lib."), "seq").alias("name"), null("string").alias("sha256"))
    fuzzy = stores.first_wins(stores.parse_hdb8(_lines8(docs)), ["fuzzy_type", "value"])
    hits = scan.deep_hits(slim, fuzzy, entry(slim, "ssdeep"), entry(slim, "tlsh"), "doc_id")
    out = scan.deep_report(slim, hits, True, "doc_id")

    def named(engine: str, kind: str, text: Callable[[F.Column], F.Column]) -> F.Column:
        return F.array_join(F.transform(F.filter("detections", lambda d: (d["engine"] == engine) & (d["type"] == kind)), text), ",")

    name = lambda d: d["name"]
    return out.select(
        "doc_id", named("YARA", "yara", name).alias("rules"), named("Fuzzy Hash DB", "fuzzy", lambda d: d["meta"]["fuzzy_type"]).alias("fuzzy"), named("SSDeep Hash DB", "fuzzy", name).alias("same"),
        named("TLSH Hash DB", "fuzzy-similar", lambda d: F.concat(d["name"], F.lit("="), d["score"])).alias("near"), F.array_join("scanners", ",").alias("scanners"),
    )


def _stub() -> bytes:
    """A portable executable of one section, UPX0, that may be written and run and holds the entry point; what follows is its overlay."""
    dos = b"MZ" + bytes(58) + struct.pack("<I", 64)
    optional = struct.pack("<HBB9I6H4I2H6I", 0x10B, 0, 0, 0, 0, 0, 0x1000, 0x1000, 0, 0x400000, 0x1000, 512, 4, 0, 0, 0, 4, 0, 0, 0x2000, 512, 0, 3, 0, 0, 0, 0, 0, 0, 16) + bytes(128)
    head = dos + b"PE\0\0" + struct.pack("<2H3I2H", 0x14C, 1, 0, 0, 0, len(optional), 0x102) + optional
    head += struct.pack("<8s6I2HI", b"UPX0", 512, 0x1000, 512, 512, 0, 0, 0, 0, 0xE0000020)
    return head.ljust(512, b"\0") + b"\x60\xbe".ljust(512, b"\0")


_STRINGS = ", ".join(f"('{family}', '{magic.lower()}')" for family, magic in packer.MAGIC_STRINGS)


@query(
    f"WITH ev AS (SELECT doc_id, 'UPX' AS family, 4 AS weight FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, family, 3 FROM documents, (VALUES {_STRINGS}) v(family, magic) WHERE contains(lower(text), magic)), "
    "fam AS (SELECT doc_id, family, sum(weight)::INT AS weight, least(60, 20 + (sum(weight)::INT - 1) * 12) AS score FROM ev GROUP BY ALL) "
    "SELECT doc_id, (least(60, sum(score)) + 30)::INT AS packed_score, 'high' AS confidence, string_agg(family, ',' ORDER BY weight DESC, family) AS packers FROM fam GROUP BY doc_id"
)
def scan_packers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packers of executables on their bytes: each text is the overlay of one."""
    docs = _docs(spark, sf_dir)
    samples = docs.select("doc_id", F.lit("f.exe").alias("filename"), F.concat(F.lit(_stub()), F.encode("text", "UTF-8")).alias("content"))
    slim = written(scan.deep(samples, [], [], "doc_id"))
    none = spark.createDataFrame([], f"doc_id long, detection {DETECTION}")
    packed = scan.deep_report(slim, none, False, "doc_id").select("doc_id", "static_info.packer.*")
    return packed.select("doc_id", "packed_score", "confidence", F.array_join("packers", ",").alias("packers"))


@query(
    "WITH s AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (1 + o_orderkey % 4000) AS n FROM orders UNION ALL SELECT -1, 1280 UNION ALL SELECT -2, 1024) "
    "SELECT o_orderkey, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS human FROM s"
)
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice").cast("bigint") * (1 + F.col("o_orderkey") % 4000)).alias("n"))
    more = spark.createDataFrame([(-1, 1280), (-2, 1024)], "o_orderkey long, n long")
    return rows.unionByName(more).select("o_orderkey", "n", digests.human_size(F.col("n")).alias("human"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 <> 0 THEN strftime(to_timestamp(l_partkey * 1000000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS built FROM lineitem")
def pe_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey") * 1000000).otherwise(0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", digests.pe_timestamp(seconds).alias("built"))


# --- serving ---------------------------------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT user_id, list({'t': epoch_us(ts) / 1000000.0::DOUBLE, 'i': event_id, 'keep': []::DOUBLE[], 'out': []::STRUCT(i BIGINT, ok BOOLEAN)[]} ORDER BY ts, event_id) AS l FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id), "
    "f AS (SELECT user_id, list_reduce(l, lambda a, x: {'t': x.t, 'i': x.i, "
    "'keep': CASE WHEN len(list_filter(a.keep, lambda k: x.t - k <= 7200)) < 1 THEN list_append(list_filter(a.keep, lambda k: x.t - k <= 7200), x.t) ELSE list_filter(a.keep, lambda k: x.t - k <= 7200) END, "
    "'out': list_append(a.out, {'i': x.i, 'ok': len(list_filter(a.keep, lambda k: x.t - k <= 7200)) < 1})}, {'t': 0.0::DOUBLE, 'i': 0::BIGINT, 'keep': []::DOUBLE[], 'out': []::STRUCT(i BIGINT, ok BOOLEAN)[]}) AS r FROM e) "
    "SELECT o.i AS event_id, o.ok AS accepted FROM (SELECT unnest(r.out) AS o FROM f)"
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    return serving.rate_limited(events, "user_id", "ts", "event_id", 7200, 1).select("event_id", "accepted")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.capped_history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("event_id", "user_id")


@query(
    "WITH o AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_id % 3 <> 0), n AS (SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events WHERE event_id % 3 = 0 GROUP BY ALL), "
    "a AS (SELECT *, 0 AS new FROM o UNION ALL SELECT *, 1 AS new FROM n WHERE (user_id, event_type, ts) NOT IN (SELECT (user_id, event_type, ts) FROM o)) SELECT user_id, event_type, ts, event_id FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY new DESC, event_id DESC) <= 20"
)
def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return serving.merged_history(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), "user_id", ["event_type", "ts"], "event_id", 20)


@query("SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE epoch_us(now) - epoch_us(ts) <= 864000000000 ORDER BY ts DESC, event_id DESC LIMIT 500")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return serving.evicted_cache(events, F.lit(now), "ts", "event_id", 864000, 500).select("event_id")


@query("SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE epoch_us(now) - epoch_us(ts) <= 86400000000 ORDER BY ts DESC, event_id DESC LIMIT 100")
def task_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return serving.live_tasks(events, F.lit(now), "ts", "event_id", 86400, 100).select("event_id")


@query("WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT percent, value FROM s, (VALUES (50), (95), (99), (100)) p(percent) WHERE i = least(n - 1, n * percent // 100)")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.nearest_rank(table(spark, sf_dir, "events"), "value", [50, 95, 99, 100])


@query(f"WITH {_DOCS}, f AS (SELECT sha256, min(doc_id) AS doc_id FROM d GROUP BY sha256) SELECT sha256, doc_id FROM f WHERE sha256 NOT IN (SELECT sha256 FROM d WHERE doc_id % 6 = 0)")
def sample_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("sha256", F.col("doc_id").alias("seq"))
    saved = docs.where("seq % 6 = 0").select("sha256").distinct()
    return stores.first_wins(docs, ["sha256"]).join(saved, "sha256", "left_anti").select("sha256", F.col("seq").alias("doc_id"))
