r"""Personal data by information-theoretic sanitisation, in DataFrame operations only.

Protected entities are e-mail addresses, IP addresses, payment cards and phone
numbers, found by pattern.  A term is any word of letters.  It discloses an
entity when corpus co-occurrence tells as much: with counts of whole documents
over the whole corpus, PMI(term; entity) / IC(entity) reaches 1 when the term
stands only in documents that hold the entity.  From ``disclosure`` on a term
is generalised (its first letters stay), from ``removal`` on it is removed,
wherever it stands, also in documents without the entity.

Every (entity, term) pair of a document counts, however far apart they stand.
Terms that stand in the same documents have the same ratios, and so do
entities; one of each such class is counted for all, so that a document of many
words and many entities does not give their product.

Offsets count code points.  Defined cases: null text is empty; a row that is
there k times counts k times, and each gets the same spans; an entity that
stands in every row has no information to disclose; without entities nothing is
a term; an empty table gives none; other columns are ignored, and kept by
:func:`sanitise` whatever their names.

The patterns use possessive repeats where no character could be given back,
and ``\G|(?<!...)`` in front of runs that could be entered midway: the matches
stay the same, without recursion or quadratic scans on very long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, sieve, text_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words that can be terms.
WORD = r"\p{L}+"
KEYS = ["_k1", "_k2"]
SPAN = "array<struct<start:int,end:int,value:string>>"
TERMS = "array<struct<start:int,end:int,ratio:double,action:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _luhn(m: Column) -> Column:
    def valid(digits: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
            twice = d * 2
            return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

        return F.when(F.length(digits).between(16, 19), F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return _let(_digits(m), valid)


def spans_of(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, pick: Callable[[Column], Column] | None = None) -> Column:
    """(start, end, value) of the leftmost non-overlapping matches that ``keep`` accepts; only those that ``pick`` names are placed at all.

    Matches and the text between them alternate, so starts are sums of lengths;
    they are summed by 64s, so that many matches in one text cost little.
    """

    def total(steps: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda t, x: t + x["g"] + x["w"])

    def steps_of(found: Column) -> Column:
        return _let(F.split(text, pattern, -1), lambda gaps: F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("g"), F.length(m).alias("w"), m.alias("m"))))

    def sums_of(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 64).cast("int")), lambda c: total(F.slice(steps, c * 64 + 1, F.lit(64))))

    def place(steps: Column, sums: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            chunk = F.floor(i / 64).cast("int")
            before = F.aggregate(F.slice(sums, F.lit(1), chunk), F.lit(0), lambda t, x: t + x) + total(F.slice(steps, chunk * 64 + 1, i % 64)) + x["g"]
            return _let(before, lambda start: F.struct(start.alias("start"), (start + x["w"]).alias("end"), x["m"].alias("value")))

        if pick is None:
            return F.transform(steps, span)
        wanted = F.filter(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: pick(F.get(steps, i)["m"]))
        return F.transform(wanted, lambda i: span(F.get(steps, i), i))

    def spans(found: Column) -> Column:
        return F.when(F.size(found) > 0, _let(steps_of(found), lambda steps: _let(sums_of(steps), lambda sums: place(steps, sums)))).otherwise(F.array().cast(SPAN))

    out = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.filter(out, lambda x: keep(x["value"])) if keep else out


def entities(text: Column) -> dict[str, Column]:
    """Spans of each kind; a cheap test in front skips texts that cannot match."""
    none = F.array().cast(SPAN)
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans_of(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), spans_of(text, IP, lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))).otherwise(none),
        "card": F.when(text.rlike("[0-9][0-9 -]{14}"), spans_of(text, CARD, _luhn)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), spans_of(text, PHONE, lambda m: F.length(_digits(m)).between(8, 15))).otherwise(none),
    }


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row key, one array of spans for each kind, words: the distinct words of a text with entities, else null)."""
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), text_of(text_col).alias("_text"))
    rows = rows.select("*", *[c.alias(k) for k, c in entities(F.col("_text")).items()])
    return rows.select("id", *KEYS, *KINDS, F.when(F.size(F.concat(*KINDS)) > 0, _words(F.col("_text"))).alias("words"))


def _words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _classes(postings: DataFrame, name: str, *same: str) -> DataFrame:
    """(name, as): of values that stand in the same rows (and agree in ``same``) the least stands for all."""
    row = F.xxhash64(*KEYS)
    told = postings.groupBy(name, *same).agg(F.count("*").alias("_c"), F.bit_xor(row).alias("_x"), F.sum(row.cast("decimal(20,0)")).alias("_s"))
    told = cut(told, "classes")
    least = told.groupBy("_c", "_x", "_s", *same).agg(F.min(name).alias("as"))
    return cut(told.join(least, ["_c", "_x", "_s", *same]).select(name, "as", *same, F.col("_c").alias("rows")), "classes")


def disclosures(docs: DataFrame, base: DataFrame, disclosure: float = 0.8, text_col: str = "text") -> DataFrame:
    """(term, ratio) of the terms that disclose an entity.

    The ratio cannot exceed IC(term) / IC(entity), so only terms that reach
    ``disclosure`` with the most frequent entity are paired; no other could.
    """
    holding = base.where(F.col("words").isNotNull())
    named = F.concat(*[F.transform(k, lambda s, k=k: F.concat(F.lit(f"{k}:"), F.lower(s["value"]))) for k in KINDS])
    holds = cut(holding.select(*KEYS, F.explode(F.array_distinct(named)).alias("entity")), "entities")
    entity = _classes(holds, "entity").withColumnRenamed("rows", "de")
    total = docs.agg(F.count("*").alias("n"))
    # the most rows that an entity has, below all of them: one row
    most = cut(entity.crossJoin(F.broadcast(total)).where("de < n").groupBy("n").agg(F.max("de").alias("most")), "most")
    here = holding.select(*KEYS, F.explode("words").alias("term"))
    terms = cut(here.select("term").distinct(), "terms")
    df = sieve(docs.select(F.explode(_words(text_of(text_col))).alias("term")), terms, "term").groupBy("term").agg(F.count("*").alias("df"))
    ic = lambda x: F.log2(F.col("n") / F.col(x))
    able = df.join(terms, "term", "left_semi").crossJoin(F.broadcast(most)).where(F.round(ic("df") / ic("most"), 9) >= disclosure)
    postings = cut(here.join(cut(able.select("term", "df", "n"), "able"), "term"), "postings")
    term = _classes(postings, "term", "df", "n")
    left = postings.join(term.where("term = `as`").select("term"), "term", "left_semi")
    right = holds.join(entity.where("entity = `as`").select("entity", "de"), "entity").distinct()
    seen = left.join(right, KEYS).where((F.col("n") > F.col("de")) & (F.round(ic("df") / ic("de"), 9) >= disclosure))
    seen = seen.groupBy("term", "entity", "df", "de", "n").agg(F.count("*").alias("both"))
    pmi = F.log2(F.col("n") * F.col("both") / (F.col("df") * F.col("de")))
    ratios = seen.select(F.col("term").alias("as"), F.least(F.round(pmi / ic("de"), 9), F.lit(1.0)).alias("ratio")).where(F.col("ratio") >= disclosure)
    best = cut(ratios.groupBy("as").agg(F.max("ratio").alias("ratio")), "ratios")
    return term.join(best, "as").select("term", "ratio")


def detect(docs: DataFrame, disclosure: float = 0.8, removal: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row key, spans of each kind, terms: start, end, ratio, action) of every row."""
    base = cut(found(docs, id_col, text_col), "entities")
    rated = cut(disclosures(docs, base, disclosure, text_col), "rated")
    words = docs.select(*row_key(id_col, text_col), F.explode(_words(text_of(text_col))).alias("term"))
    hits = sieve(words, rated, "term").join(rated, "term").groupBy(*KEYS).agg(F.map_from_entries(F.collect_set(F.struct("term", "ratio"))).alias("_ratios"))
    texts = docs.select(*row_key(id_col, text_col), text_of(text_col).alias("_text"))
    marked = texts.join(hits.hint("shuffle_hash"), KEYS).dropDuplicates(KEYS)
    words = spans_of(F.col("_text"), WORD, pick=lambda w: F.map_contains_key("_ratios", F.lower(w)))

    def term(s: Column) -> Column:
        action = lambda r: F.when(r >= removal, F.lit("remove")).otherwise(F.lit("generalise"))
        return _let(F.try_element_at("_ratios", F.lower(s["value"])), lambda r: F.struct(s["start"].alias("start"), s["end"].alias("end"), r.alias("ratio"), action(r).alias("action")))

    marked = marked.select(*KEYS, F.transform(words, term).alias("terms"))
    inside = lambda t: F.exists(F.concat(*KINDS), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    out = base.drop("words").join(marked, KEYS, "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))
    return out.withColumn("terms", F.filter("terms", lambda t: ~inside(t)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """All columns of ``docs`` with entities named by kind and disclosing terms generalised or removed.

    Of overlapping spans the first stays, then the longer one.
    """
    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("to")))

    # a null replacement stands for a generalised term
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.when(s["action"] == "remove", F.lit("[TERM]")).alias("to")))
    spans = detect(docs, id_col=id_col, text_col=text_col, **rules).select(*KEYS, F.sort_array(F.concat(*[of(k) for k in KINDS], terms)).alias("_all")).dropDuplicates(KEYS)
    joined = docs.select(F.struct("*").alias("_row"), *row_key(id_col, text_col)).join(spans.hint("shuffle_hash"), KEYS, "left")
    whole = F.col(f"_row.`{text_col}`")

    def step(acc: Column, s: Column) -> Column:
        to = F.coalesce(s["to"], F.concat(F.substring(whole, s["start"] + 1, F.lit(2)), F.lit("...")))
        new = F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), to).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    folded = F.aggregate("_all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.length(whole))))
    text = F.when(F.size("_all") > 0, folded).otherwise(whole)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
