"""Line deduplication by log-template trees, in DataFrame operations only.

A line's tokens are its words between blanks; tokens with a digit are variable
fields (``<*>``).  Lines go down a tree of fixed depth: token count, then the
first ``DEPTH`` tokens.  In a leaf, the most frequent token of each position
makes a template; lines that agree with it in ``similarity`` of their positions
belong to it, and the lines left over make the next one.  Where no two lines
agree with theirs, the leaf is parted by the position with the fewest different
tokens, until no part of several lines is left; a line without company is its
own template.

A template that recurs is dropped everywhere but at its first place: one that
stands in two documents or more, and whose tokens there are ``min_tokens`` or
more when they are counted once a document.  So a line of 30 tokens goes on its
second document, a line of 6 on its tenth, a single word on its sixtieth.

Defined cases: null text stays null; empty lines stay; rows that agree in id
and text count as one document and get the same result; the first place is the
least (id, text hash, line number), null ids before others; columns named
n_lines and n_dropped are replaced, all others are untouched, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, row_key, text_of

DEPTH = 3
#: Tokens that a template's documents must hold together to be dropped.
MIN_TOKENS = 60
KEYS = ["_k1", "_k2"]


def _plain(line: Column) -> Column:
    """The line with blanks as its only token separators; ``translate`` is slow, so it sees few lines."""
    other = [F.contains(line, F.lit(c)) for c in "\t\r\f\u000b"]
    return F.trim(F.when(other[0] | other[1] | other[2] | other[3], F.translate(line, "\t\r\f\u000b", "    ")).otherwise(line))


def _generalise(plain: Column) -> Column:
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<!\S)\S*[0-9]\S*", "<*>")).otherwise(plain)


def templates(text: Column) -> Column:
    """The template of each line of a text: its tokens, variable fields generalised."""
    return F.transform(F.transform(F.split(text, "\n"), _plain), _generalise)


def token_count(template: Column) -> Column:
    return F.when(template == "", 0).otherwise(F.octet_length(template) - F.octet_length(F.replace(template, F.lit(" "), F.lit(""))) + 1)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row key, pos, template, n, lead, t1, t2) of every line that can be dropped."""
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.posexplode(templates(text_of(text_col))).alias("pos", "template"))
    rows = rows.withColumn("n", token_count(F.col("template"))).where("n > 0")
    return rows.withColumns({"lead": F.xxhash64(F.substring_index("template", " ", DEPTH)), "t1": F.xxhash64("template"), "t2": F.xxhash64(F.lit(5), "template")})


def _modes(found: DataFrame) -> DataFrame:
    """(leaf, mode): the most frequent token of each position of a leaf's templates."""
    tokens = found.select("leaf", F.posexplode(F.split("template", " ")).alias("i", "token"))
    modes = tokens.groupBy("leaf", "i", "token").count().groupBy("leaf", "i").agg(F.max(F.struct("count", "token")).alias("m"))
    return modes.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m.token"))), lambda x: x["token"]).alias("mode"))


def _parted(left: DataFrame) -> DataFrame:
    """(leaf, t1, t2, template): each leaf parted by its position with the fewest different tokens, two at least."""
    tokens = left.select("leaf", F.posexplode(F.split("template", " ")).alias("i", "token")).distinct()
    by = tokens.groupBy("leaf", "i").agg(F.count("*").alias("kinds")).where("kinds > 1").groupBy("leaf").agg(F.min(F.struct("kinds", "i"))["i"].alias("i"))
    parts = left.join(by, "leaf").withColumn("leaf", F.xxhash64("leaf", F.get(F.split("template", " "), F.col("i"))))
    return parts.select("leaf", "t1", "t2", "template")


def _of_several(found: DataFrame) -> DataFrame:
    """The rows of leaves of two templates or more."""
    some = found.groupBy("leaf").agg(F.count("*").alias("c")).where("c > 1").select("leaf")
    return found.join(some, "leaf", "left_semi")


def _generalised(docs: DataFrame, keyed: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(t1, t2, g): the template that several different lines share, for those that share one.

    Each round takes the lines of one template out of every leaf or parts it, all
    leaves at once; both leave fewer lines in a leaf, so the rounds end.
    """
    leaves = cut(keyed.groupBy("n", "lead").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo < hi").select("n", "lead"), "leaves")
    # one line of each template of such a leaf lends its text
    lent = keyed.join(leaves, ["n", "lead"]).groupBy("n", "lead", "t1", "t2").agg(F.min(F.struct(*KEYS, "pos")).alias("at"))
    wanted = lent.select("at.*", "n", "lead", "t1", "t2").groupBy(*KEYS).agg(F.collect_list(F.struct("pos", "n", "lead", "t1", "t2")).alias("want"))
    texts = docs.select(*row_key(id_col, text_col), text_of(text_col).alias("_text"))
    found = texts.join(wanted.hint("shuffle_hash"), KEYS).select("want", templates(F.col("_text")).alias("_templates")).withColumn("w", F.explode("want")).select("w.*", F.get(F.col("_templates"), F.col("w.pos")).alias("template"))
    # a row that is there twice lends its lines twice
    found = cut(found.groupBy(F.xxhash64("n", "lead").alias("leaf"), "t1", "t2").agg(F.max("template").alias("template")), "templates")
    out, turn = None, 0
    while True:
        tokens, mode = F.split("template", " "), F.col("mode")
        same = F.size(F.filter(F.zip_with(tokens, mode, lambda a, b: a.eqNullSafe(b)), lambda x: x))
        near = found.join(_modes(found), "leaf").select("leaf", "t1", "t2", "template", (same >= similarity * F.size(mode)).alias("near"))
        near = cut(near, "agreeing")
        shared = near.where("near").groupBy("leaf").agg(F.count("*").alias("c")).where("c > 1").select("leaf", F.lit(True).alias("shared"))
        near = cut(near.join(shared, "leaf", "left").select("leaf", "t1", "t2", "template", "near", F.col("shared").isNotNull().alias("shared")), "shared")
        taken = near.where("shared AND near").select("t1", "t2", F.xxhash64(F.lit(11), F.lit(turn), "leaf").alias("g"))
        out = taken if out is None else out.unionByName(taken)
        turn += 1
        rest = near.where("shared AND NOT near").drop("near", "shared")
        found = cut(_of_several(rest.unionByName(_parted(near.where("NOT shared").drop("near", "shared")))), "templates")
        del near, shared, taken, rest, same, mode, tokens
        release(docs.sparkSession)  # rounds are many, and what they shuffled is written
        if found.isEmpty():
            return out


def drops(docs: DataFrame, min_tokens: int = MIN_TOKENS, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row key, dropped: line numbers) of every document that loses lines.

    What lines are joined with is written first, so that a line that many
    documents share is a skewed key of a join alone, which is split at run time.
    """
    keyed = cut(_lines(docs, id_col, text_col).drop("template"), "lines")
    general = cut(_generalised(docs, keyed, similarity, id_col, text_col), "general")
    # a line belongs to a shared template, or else to its own
    named = keyed.join(general, ["t1", "t2"], "left")
    lines = cut(named.select("id", *KEYS, "pos", "n", F.coalesce("g", "t1").alias("g1"), F.when(F.col("g").isNull(), F.col("t2")).otherwise(F.lit(0)).alias("g2")), "named")
    per_doc = lines.groupBy("g1", "g2", "n", *KEYS).agg(F.min(F.struct("id", "_k2", "pos")).alias("place"))
    often = per_doc.groupBy("g1", "g2", "n").agg(F.count("*").alias("docs"), F.min("place").alias("first"))
    often = cut(often.where((F.col("docs") >= 2) & (F.col("docs") * F.col("n") >= min_tokens)).select("g1", "g2", "n", "first"), "often")
    place = F.struct("id", "_k2", "pos")
    gone = lines.join(often, ["g1", "g2", "n"]).where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy(*KEYS).agg(F.collect_set("pos").alias("dropped"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """All columns of ``docs`` with the text rid of dropped lines, and n_lines, n_dropped.

    The keys of what is dropped are built into hash tables, so the texts are
    shuffled once and never sorted.
    """
    gone = drops(docs, id_col=id_col, text_col=text_col, **rules)
    text, lost = F.col(f"_row.`{text_col}`"), F.col("dropped")
    joined = docs.select(F.struct("*").alias("_row"), *row_key(id_col, text_col)).join(gone.hint("shuffle_hash"), KEYS, "left").withColumn("_lines", F.split(text.cast("string"), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), lost)
    kept = F.when(lost.isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in names],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(lost.isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long").alias("n_dropped"),
    )
