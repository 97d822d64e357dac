"""The scan as one plan: digests, types, lookups, rules, static analysis, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions import ctph, filetype, pe, tlsh
from lithos.functions.digests import digests, human_size
from lithos.operators import packer, similarity
from lithos.operators import rules as R
from lithos.operators.lookup import ENGINES, computed, exact, ssdeep_exact
from lithos.operators.stores import keep_newest, upsert
from lithos.schemas import DETECTION
from lithos.sources.files import INLINE_BYTES
from lithos.sources.tables import written

FUZZY_BYTES = 2 << 20
#: Larger samples get rules only in the second phase.
DEEP_BYTES = 32 << 20
# Notes of what was left out.
TOO_LARGE = f"样本超过阶段2深度分析上限 ({DEEP_BYTES >> 20}MB), 已跳过模糊哈希/PE元数据/查壳, 仅执行 YARA 规则匹配"
# What the fuzzy hashes are called.
FUZZY_LABELS = {"imphash": "Imphash", "authentihash": "Authentihash"}
#: Places of the second phase's engines in a report; rules stand before them in their own order.
AFTER_RULES = {"fuzzy": 1_000_000, "ssdeep": 1_000_010, "ssdeep_similar": 1_000_020, "tlsh_similar": 1_000_100}


def _detection(ord_: Column, engine: str, kind: str, name: Column, detail: Column, size: Column, score: Column | None = None, meta: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        ord_.alias("ord"), F.lit(engine).alias("engine"), F.lit(kind).alias("type"), name.alias("name"), detail.alias("detail"), size.cast("bigint").alias("size"),
        (score if score is not None else null).cast("int").alias("score"), (meta if meta is not None else null).cast("map<string,string>").alias("meta"),
    ).cast(DETECTION)


def first_phase(samples: DataFrame) -> DataFrame:
    """Adds size, digests and the file type."""
    sized = samples.withColumns({"size": F.octet_length("content").cast("bigint"), **digests(F.col("content"))})
    return filetype.refined(sized)


def hash_hits(scanned: DataFrame, sha256: DataFrame, md5: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, detection) of both digest stores."""
    out = None
    for i, (kind, store) in enumerate((("sha256", sha256), ("md5", md5))):
        hits = exact(scanned.select(key, kind, "size"), store, kind)
        hits = hits.select(key, _detection(F.lit(i), ENGINES[kind], "hash", F.col("sig_name"), F.concat(F.lit(f"{kind.upper()}: "), F.col(kind)), F.col("sig_size")).alias("detection"))
        out = hits if out is None else out.unionByName(hits)
    return out


def report(samples: DataFrame, sha256: DataFrame, md5: DataFrame, rules: list[R.Rule], key: str = "sample_id") -> DataFrame:
    """One row for each sample: what it is, all detections in order, and the verdict.

    Detections come in the order digest, type, rules.  Only hits are joined
    back, so content never goes through a shuffle.
    """
    typed = first_phase(samples)
    matched = R.scan(typed, rules)
    local = F.concat(
        F.transform(filetype.signals(F.col("filename"), F.col("file_type")), lambda s, i: F.struct((i + 10).alias("ord"), s["engine"].alias("engine"), s["type"].alias("type"), s["name"].alias("name"), s["detail"].alias("detail"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("int").alias("score"), F.lit(None).cast("map<string,string>").alias("meta")).cast(DETECTION)),
        F.transform(R.detections(F.col("rule_hits")), lambda d: d.withField("ord", d["ord"] + 20)),
    )
    rows = matched.select(key, "filename", "size", human_size(F.col("size")).alias("size_human"), *digests(F.col("content")), "file_type", local.alias("_local"))
    hits = hash_hits(rows, sha256, md5, key).groupBy(key).agg(F.collect_list("detection").alias("_hits"))  # at most one for each store
    joined = rows.join(hits, key, "left")
    found = F.concat(F.coalesce("_hits", F.array().cast(f"array<{DETECTION}>")), F.col("_local"))
    joined = joined.withColumn("detections", F.array_sort(found, lambda a, b: a["ord"] - b["ord"])).drop("_hits", "_local")
    return judged(joined, bool(rules))


def judged(rows: DataFrame, with_rules: bool = True) -> DataFrame:
    """Adds clean, verdict and the engines that took part."""
    typed = F.exists("detections", lambda d: d["engine"] == "FileType")
    engines = [F.lit(ENGINES["sha256"]), F.lit(ENGINES["md5"]), F.when(typed, F.lit("FileType Analysis")), F.when(F.lit(with_rules), F.lit("YARA"))]
    clean = F.size("detections") == 0
    return rows.withColumns({"clean": clean, "verdict": F.when(clean, "CLEAN").otherwise("DETECTED"), "scanners": F.array_compact(F.array(*engines))})


def static_info(typed: DataFrame, table: bytes | None = None) -> DataFrame:
    """Adds pe, ssdeep, tlsh, imphash, authentihash and notes; samples beyond the size limits skip what costs.

    A Python worker would see every row of a ``when``, so large samples and
    non-executables are told by null content instead.
    """
    small = F.when(F.octet_length("content") <= FUZZY_BYTES, F.col("content"))
    inline = F.when((F.octet_length("content") <= INLINE_BYTES) & pe.is_pe(F.col("content")), F.col("content"))
    out = typed.withColumns({"ssdeep": ctph.digest_column(small), "tlsh": tlsh.digest_column(small, table), "pe": pe.parsed(inline)})
    n = F.octet_length("content")
    notes = F.array_compact(
        F.array(
            F.when(n > FUZZY_BYTES, F.lit("样本超过 2MB, 跳过 ssdeep/tlsh 计算")),
            F.when((n <= FUZZY_BYTES) & (n >= tlsh.MIN_BYTES) & F.col("tlsh").isNull(), F.lit("tlsh 不可用: 内容复杂度不足或输入过短")),
        )
    )
    return out.withColumns({"imphash": F.col("pe.imphash"), "authentihash": F.col("pe.authentihash"), "notes": notes})


def deep(samples: DataFrame, rules: list[R.Rule], packer_rules: list[R.Rule], key: str = "sample_id", table: bytes | None = None) -> DataFrame:
    """What the second phase takes from contents: (key, size, rule_hits, notes, fuzzy hashes, pe, packer evidence and heuristics).

    Contents do not come along, so all that follows is slim.  Rules see every
    sample; those over ``DEEP_BYTES`` have nothing else, and a note instead.
    """
    rows = R.scan(samples.withColumn("size", F.octet_length("content").cast("bigint")), rules)
    over = F.col("size") > DEEP_BYTES
    rows = static_info(rows.withColumn("content", F.when(~over, F.col("content"))), table)
    known = F.when(F.col("pe").isNotNull(), F.col("content"))
    rows = R.scan(rows.withColumn("_packed", known), packer_rules, "_packed", "_packer_hits")
    evidence = F.when(F.col("pe").isNotNull(), packer.evidence(F.col("content"), F.col("pe"), F.col("_packer_hits")))
    notes = F.when(over, F.array(F.lit(TOO_LARGE))).otherwise(F.col("notes"))
    return rows.select(key, "size", "rule_hits", notes.alias("notes"), "ssdeep", "tlsh", "imphash", "authentihash", "pe", evidence.alias("evidence"), F.when(F.col("pe").isNotNull(), packer.heuristics(F.col("pe"))).alias("heuristics"))


def deep_hits(slim: DataFrame, fuzzy: DataFrame, ssdeep: DataFrame, tlsh_library: DataFrame, key: str = "sample_id", scores: tuple[int, int] = (50, 5), distances: tuple[int, int] = (40, 10)) -> DataFrame:
    """(key, detection) of the fuzzy store, then exact and similar entries of the ssdeep library, then similar ones of the TLSH library.

    Libraries are (ssdeep or tlsh, seq, sha256, size, name), an entry for each
    digest.  ``scores`` and ``distances`` are the threshold and the most entries.
    """
    named = F.coalesce(F.col("e_name"), F.lit("unknown"))
    of = lambda kind: F.create_map(F.lit("sha256"), F.col("e_sha256"), F.lit(kind), F.col(f"e_{kind}"))
    sig = F.create_map(F.lit("fuzzy_type"), F.col("fuzzy_type"), F.lit("sha256"), F.col("sig_sha256"))
    hits = computed(slim, fuzzy, key)
    label = F.when(F.col("fuzzy_type") == "imphash", FUZZY_LABELS["imphash"]).otherwise(FUZZY_LABELS["authentihash"])
    out = hits.select(key, _detection(F.col("ord") + AFTER_RULES["fuzzy"], ENGINES["fuzzy"], "fuzzy", F.col("sig_name"), F.concat(label, F.lit(" 命中")), F.col("sig_size"), meta=sig).alias("detection"))
    pieces = slim.where("ssdeep IS NOT NULL").select(key, "size", "ssdeep")
    same = ssdeep_exact(pieces.withColumnRenamed("ssdeep", "value"), ssdeep.withColumn("name", F.struct("name", "sha256")))
    sig = F.create_map(F.lit("fuzzy_type"), F.lit("ssdeep"), F.lit("sha256"), F.col("sig_name.sha256"))
    out = out.unionByName(same.select(key, _detection(F.lit(AFTER_RULES["ssdeep"]), ENGINES["ssdeep"], "fuzzy", F.col("sig_name.name"), F.lit("SSDeep 命中"), F.col("sig_size"), meta=sig).alias("detection")))
    near = similarity.ssdeep_top(pieces, ssdeep, key, "seq", *scores)
    detail = F.concat(F.lit("ssdeep 相似度 "), "score", F.lit("/100"))
    out = out.unionByName(near.select(key, _detection(F.col("rank") + AFTER_RULES["ssdeep_similar"], ENGINES["ssdeep"], "fuzzy-similar", named, detail, F.col("e_size"), F.col("score"), of("ssdeep")).alias("detection")))
    near = similarity.tlsh_top(slim.where("tlsh IS NOT NULL").select(key, "tlsh"), tlsh_library, key, *distances)
    detail = F.concat(F.lit("TLSH 距离 "), "distance", F.lit(" (越小越相似)"))
    return out.unionByName(near.select(key, _detection(F.col("rank") + AFTER_RULES["tlsh_similar"], ENGINES["tlsh"], "fuzzy-similar", named, detail, F.col("e_size"), F.col("distance"), of("tlsh")).alias("detection")))


def deep_report(slim: DataFrame, hits: DataFrame, with_rules: bool = True, key: str = "sample_id") -> DataFrame:
    """(key, detections in order, static_info, notes, scanners) of every row of ``slim``.

    ``static_info`` holds the fuzzy hashes, the executable and its packers.
    """
    grouped = hits.groupBy(key).agg(F.collect_list("detection").alias("_hits"))  # bounded by the most entries of each engine
    packed = slim.where("pe IS NOT NULL")
    packers = packer.fuse(packed.select(key, F.explode("evidence").alias("x")).select(key, "x.family", "x.weight"), packed.select(key, F.explode("heuristics").alias("x")).select(key, "x.weight"), key)
    packers = packers.select(key, F.struct("detected", "confidence", "packed_score", "packers").alias("_packer"))
    rows = slim.join(grouped, key, "left").join(packers, key, "left")
    found = F.concat(R.detections(F.col("rule_hits")), F.coalesce("_hits", F.array().cast(f"array<{DETECTION}>")))
    info = F.struct("ssdeep", "tlsh", "imphash", "authentihash", "pe", F.col("_packer").alias("packer"))
    engines = F.array(F.when(F.lit(with_rules), F.lit("YARA")), F.when(F.col("ssdeep").isNotNull(), F.lit(ENGINES["ssdeep"])), F.when(F.col("tlsh").isNotNull(), F.lit(ENGINES["tlsh"])))
    return rows.select(key, F.array_sort(found, lambda a, b: a["ord"] - b["ord"]).alias("detections"), info.alias("static_info"), "notes", F.array_compact(engines).alias("scanners"))


def second_phase(samples: DataFrame, rules: list[R.Rule], packer_rules: list[R.Rule], fuzzy: DataFrame, ssdeep: DataFrame, tlsh_library: DataFrame, key: str = "sample_id", table: bytes | None = None) -> DataFrame:
    """:func:`deep_report` of samples; contents are read and digested once, since the slim rows are written."""
    slim = written(deep(samples, rules, packer_rules, key, table))
    return deep_report(slim, deep_hits(slim, fuzzy, ssdeep, tlsh_library, key), bool(rules), key)


def merged(first: DataFrame, second: DataFrame, key: str = "sample_id") -> DataFrame:
    """The report of both phases: detections and engines one after the other, the verdict over both.

    ``first`` is :func:`report` without rules, which the second phase matches.
    Samples that the second has not reached keep what the first says.
    """
    more = second.select(key, F.col("detections").alias("_more"), F.col("scanners").alias("_engines"), "static_info", "notes")
    joined = first.join(more, key, "left").withColumns({
        "detections": F.concat("detections", F.coalesce("_more", F.array().cast(f"array<{DETECTION}>"))),
        "scanners": F.concat("scanners", F.coalesce("_engines", F.array().cast("array<string>"))),
    })
    clean = F.size("detections") == 0
    return joined.drop("_more", "_engines").withColumns({"clean": clean, "verdict": F.when(clean, "CLEAN").otherwise("DETECTED")})


def known(scanned: DataFrame) -> Column:
    """The name under which a digest store knows a sample of a report: its first hit; null if none does."""
    hits = F.filter("detections", lambda d: d["engine"].isin(ENGINES["sha256"], ENGINES["md5"]))
    return F.when(F.size(hits) > 0, F.coalesce(F.get(hits, F.lit(0))["name"], F.lit("unknown")))


def grown(library: DataFrame, scanned: DataFrame, kind: str, seq: str = "sample_id", most: int | None = None) -> DataFrame:
    """The ssdeep or tlsh library after a batch of merged reports: samples that a digest store knows come in.

    ``seq`` tells the order of arrival and must lie above the library's.  Only
    known samples enter, after the search has used the library; ``most`` keeps
    the newest entries.
    """
    rows = scanned.select(F.col(f"static_info.{kind}").alias(kind), F.col(seq).alias("seq"), "sha256", "size", known(scanned).alias("name"))
    grown_by = upsert(library, rows.where(F.col(kind).isNotNull() & F.col("name").isNotNull()), kind, ["sha256", "size", "name"])
    return grown_by if most is None else keep_newest(grown_by, most)
