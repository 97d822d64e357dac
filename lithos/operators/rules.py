"""Byte-pattern rules compiled to column expressions.

Read is the subset that the shipped rule files use: text strings with
``nocase``, ``ascii`` and ``wide``, hex strings with ``??``, and conditions of
``and``, ``or``, ``not``, brackets, ``N of (...)``, ``any/all of them`` and
``uint16(n) == value``.  A file with anything else is rejected alone, with its
reason; the others still load.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.schemas import DETECTION

SHOWN = 5


class RuleError(ValueError):
    """Text that is not of the language read here."""


class Pattern(NamedTuple):
    name: str
    text: str | None  # characters, one for each byte
    regex: str | None
    nocase: bool = False
    ascii: bool = True
    wide: bool = False


class Rule(NamedTuple):
    name: str
    meta: dict[str, str]
    patterns: tuple[Pattern, ...]
    condition: str


_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<s>"(?:[^"\\\n]|\\.)*")|(?P<h>\{[0-9A-Fa-f?\s]+\})|(?P<w>[$#@]?[A-Za-z_]\w*\*?|\$\*?|0x[0-9A-Fa-f]+|\d+)|(?P<p>==|[{}():=,-])', re.S)
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "r": "\r"}


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"unreadable at {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append(m[0])
        at = m.end()
    return out


def _unquoted(token: str) -> str:
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "x" and len(m[1]) == 3 else _ESCAPES.get(m[1], m[1]), token[1:-1]).encode().decode("latin-1")


def parse(text: str) -> list[Rule]:
    """The rules of one file."""
    tokens, out, at = _tokens(text), [], 0

    def need(*wanted: str) -> None:
        nonlocal at
        for w in wanted:
            if at >= len(tokens) or tokens[at] != w:
                raise RuleError(f"{w!r} expected")
            at += 1

    def peek() -> str:
        if at >= len(tokens):
            raise RuleError("the file ends early")
        return tokens[at]

    while at < len(tokens):
        need("rule")
        name, meta, patterns = peek(), {}, []
        at += 1
        if peek() == ":":
            while peek() != "{":
                at += 1
        need("{")
        if peek() == "meta":
            need("meta", ":")
            while peek() not in ("strings", "condition"):
                key = peek()
                at += 1
                need("=")
                sign = "-" if peek() == "-" else ""
                at += bool(sign)
                meta[key] = sign + (_unquoted(peek()).encode("latin-1").decode() if peek()[0] == '"' else peek())
                at += 1
        if peek() == "strings":
            need("strings", ":")
            while peek() != "condition":
                key = peek()
                if key[0] != "$":
                    raise RuleError(f"{key!r} names no string")
                at += 1
                need("=")
                value, flags = peek(), set()
                at += 1
                while peek() in ("nocase", "wide", "ascii"):
                    flags.add(peek())
                    at += 1
                if value[0] == '"':
                    patterns.append(Pattern(key, _unquoted(value), None, "nocase" in flags, "ascii" in flags or "wide" not in flags, "wide" in flags))
                elif value[0] == "{":
                    digits = re.sub(r"\s", "", value[1:-1])
                    pairs = re.findall("..", digits)
                    if len(digits) % 2 or any("?" in p and p != "??" for p in pairs):
                        raise RuleError("half bytes are not read")
                    patterns.append(Pattern(key, None, "(?s)" + "".join("." if p == "??" else rf"\x{p}" for p in pairs)))
                else:
                    raise RuleError(f"{value!r} is no string")
        need("condition", ":")
        words = []
        while peek() != "}":
            words.append(peek())
            at += 1
        need("}")
        rule = Rule(name, meta, tuple(patterns), " ".join(words))
        condition(rule, {p.name: None for p in patterns}, None)
        out.append(rule)
    return out


def condition(rule: Rule, hits: Mapping[str, Column | None], content: Column | None) -> Column | None:
    """The rule's condition over its strings' hits; with null hits only the syntax is read."""
    words, at, dry = rule.condition.split(), 0, content is None

    def peek() -> str:
        return words[at] if at < len(words) else ""

    def step(wanted: str | None = None) -> str:
        nonlocal at
        word = peek()
        if not word or wanted not in (None, word):
            raise RuleError(f"{rule.name}: {wanted or 'more'} expected in the condition")
        at += 1
        return word

    def some() -> list[str]:
        if peek() == "them":
            step()
            return list(hits)
        step("(")
        names = []
        while True:
            w = step()
            names += [h for h in hits if h.startswith(w[:-1])] if w.endswith("*") else [w]
            if step() == ")":
                return names

    def atom() -> Column | None:
        w = step()
        if w == "(":
            inner = either()
            step(")")
            return inner
        if w == "not":
            inner = atom()
            return None if dry else ~inner
        if w in ("true", "false"):
            return None if dry else F.lit(w == "true")
        if w.startswith("$"):
            if w not in hits:
                raise RuleError(f"{rule.name}: no string {w}")
            return hits[w]
        if w == "uint16":
            step("(")
            offset = int(step(), 0)
            step(")")
            step("==")
            value = int(step(), 0)
            return None if dry else F.coalesce(F.substring(content, offset + 1, 2) == F.lit(value.to_bytes(2, "little")), F.lit(False))
        if w in ("any", "all") or w.isdigit():
            step("of")
            names = some()
            if not names or any(n not in hits for n in names):
                raise RuleError(f"{rule.name}: unknown strings")
            least = {"any": 1, "all": len(names)}.get(w) or int(w)
            return None if dry else sum((hits[n].cast("int") for n in names[1:]), hits[names[0]].cast("int")) >= least
        raise RuleError(f"{rule.name}: {w!r} is not read")

    def both() -> Column | None:
        out = atom()
        while peek() == "and":
            step()
            more = atom()
            out = None if dry else out & more
        return out

    def either() -> Column | None:
        out = both()
        while peek() == "or":
            step()
            more = both()
            out = None if dry else out | more
        return out

    out = either()
    if peek():
        raise RuleError(f"{rule.name}: {peek()!r} is not read")
    return out


def load(files: Mapping[str, str]) -> tuple[list[Rule], dict[str, str]]:
    """Rules of all readable files, and why others were left out."""
    rules, errors = [], {}
    for name in sorted(files):
        try:
            rules += parse(files[name])
        except RuleError as e:
            errors[name] = str(e)
    return rules, errors


def _hit(p: Pattern, latin: Column, lower: Column) -> Column:
    if p.regex:
        return latin.rlike(p.regex)
    text, where = (p.text.lower(), lower) if p.nocase else (p.text, latin)
    forms = ([text] if p.ascii else []) + (["".join(c + "\x00" for c in text)] if p.wide else [])
    out = F.contains(where, F.lit(forms[0]))
    for f in forms[1:]:
        out = out | F.contains(where, F.lit(f))
    return out


def matches(content: Column, latin: Column, rules: list[Rule]) -> Column:
    """Matching rules in order: (rule, strings, meta).  ``latin`` is the content, a character a byte."""
    upper = "".join(chr(c) for c in range(65, 91))
    lower = F.translate(latin, upper, upper.lower())  # ASCII letters only
    out = []
    for r in rules:
        hits = {p.name: F.coalesce(_hit(p, latin, lower), F.lit(False)) for p in r.patterns}
        named = F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in hits.items()])) if hits else F.array().cast("array<string>")
        meta = F.create_map(*[F.lit(x) for kv in r.meta.items() for x in kv]) if r.meta else F.create_map().cast("map<string,string>")
        out.append(F.when(condition(r, hits, content), F.struct(F.lit(r.name).alias("rule"), named.alias("strings"), meta.alias("meta"))))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<rule:string,strings:array<string>,meta:map<string,string>>>")


def scan(samples: DataFrame, rules: list[Rule], content: str = "content", out: str = "rule_hits") -> DataFrame:
    """Adds the matching rules of each sample; the content is read as characters once."""
    with_text = samples.withColumn("_latin", F.decode(F.col(content), "ISO-8859-1"))
    return with_text.withColumn(out, matches(F.col(content), F.col("_latin"), rules)).drop("_latin")


def detections(hits: Column) -> Column:
    """One detection for each matching rule; its detail names up to five strings."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.transform(
        hits,
        lambda h, i: F.struct(
            i.alias("ord"), F.lit("YARA").alias("engine"), F.lit("yara").alias("type"), h["rule"].alias("name"), F.array_join(F.slice(h["strings"], 1, SHOWN), ", ").alias("detail"), null("bigint").alias("size"), null("int").alias("score"), h["meta"].alias("meta")
        ),
    ).cast(f"array<{DETECTION}>")
