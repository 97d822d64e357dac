"""Language identification by hierarchical discrimination.

A text's language family is predicted first; one-versus-one linear support
vector machines then separate the languages within that family.  Where a level
has more than ``FAN`` classes, neighbours by name are put together on a further
level, so that any number of languages gives few machines for each.  Features
are hashed byte trigrams and bigrams of the whole lower-cased text.

The classifiers are fitted on a bounded sample of labelled rows (parameter
``sample``); prediction reads every whole text.  Defined cases: a null text or
one without a letter is ``und`` with score 0; rows with null labels teach
nothing; with no labelled rows at all every text is ``und``; repeated rows and
other columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

UNDETERMINED = "und"
DIMS = 1 << 13
#: Classes that one level tells apart.
FAN = 12
#: Families by language code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = re.compile("[A-Za-z]")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"own:{lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(map(str.isalpha, text)))


def slots(text: str) -> np.ndarray:
    """Hash slots of all bigrams and trigrams of the text's bytes, a space at either end."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0x2545F491) + b[2:] * np.uint32(0xC2B2AE3D)
    return np.concatenate([(two >> np.uint32(19)), (three >> np.uint32(19))]).astype(np.int32) & (DIMS - 1)


class Machine(NamedTuple):
    """A linear machine between two classes: positive margins mean ``a``."""

    a: str
    b: str
    weights: np.ndarray
    bias: float
    slope: float  # of the logistic curve that turns margins into confidence


class Model(NamedTuple):
    """``children`` names each node's classes, from the root "" over families to languages."""

    children: dict[str, tuple[str, ...]]
    machines: dict[tuple[str, str], Machine]

    @property
    def families(self) -> tuple[str, ...]:
        return self.children.get("", ())


NOTHING = Model({}, {})


def _grow(children: dict[str, tuple[str, ...]], name: str, classes: list[str]) -> None:
    """Puts ``classes`` below ``name``, on as many levels as it takes."""
    level = 0
    while len(classes) > FAN:
        level += 1
        groups = [classes[i : i + FAN] for i in range(0, len(classes), FAN)]
        children |= {f"{name}/{level}.{i}": tuple(g) for i, g in enumerate(groups)}
        classes = [f"{name}/{level}.{i}" for i in range(len(groups))]
    children[name] = tuple(classes)


def _machine(x: np.ndarray, y: np.ndarray, a: str, b: str, rounds: int = 150, penalty: float = 1e-3) -> Machine:
    """Squared-hinge linear SVM by accelerated gradient descent; classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, c = np.zeros(x.shape[1], np.float32), np.float32(0)
    v, vc = w.copy(), c
    top = float((weight * ((x * x).sum(axis=1) + 1)).sum()) * 2 + penalty
    for t in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v + vc)) * weight * y
        nw, nc = v - (penalty * v - 2 * gap @ x) / top, vc + 2 * gap.sum() / top
        v, vc = nw + (t / (t + 3)) * (nw - w), nc + (t / (t + 3)) * (nc - c)
        w, c = nw, nc
    margins = y * (x @ w + c)
    slope = min(range(1, 13), key=lambda s: float((weight * np.logaddexp(0, -s * margins)).sum()))
    return Machine(a, b, w, float(c), float(slope))


def fit_arrays(x: np.ndarray, langs: list[str]) -> Model:
    names, children, machines = np.array(langs), {}, {}
    by: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by.setdefault(f"family {family_of(lang)}", []).append(lang)
    for family, some in by.items():
        _grow(children, family, some)
    _grow(children, "", sorted(by))

    def below(name: str) -> set[str]:
        return set().union(*(below(c) for c in children[name])) if name in children else {name}

    for classes in children.values():
        held = {c: np.isin(names, sorted(below(c))) for c in classes} if len(classes) > 1 else {}
        for a, b in combinations(classes if held else (), 2):
            at = held[a] | held[b]
            machines[a, b] = _machine(x[at], np.where(held[a][at], 1, -1).astype(np.float32), a, b)
    return Model(children, machines)


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies, scaled so that a row's length is about one."""
    return (counts * np.float32(8) / np.maximum(1, counts.sum(axis=-1, keepdims=True))).astype(np.float32)


def _vote(classes: tuple[str, ...], margin: dict[tuple[str, str], float], machines: dict) -> tuple[str, float]:
    """The class with most wins, then the largest summed margin; confidence: its mean logistic margin."""
    if len(classes) == 1:
        return classes[0], 1.0
    wins = {c: [0, 0.0, 0.0] for c in classes}
    for a, b in combinations(classes, 2):
        m = margin[a, b]
        p = 1 / (1 + np.exp(-np.clip(machines[a, b].slope * m, -50, 50)))
        for c, sign, q in ((a, 1, p), (b, -1, 1 - p)):
            wins[c][0] += sign * m > 0 or (m == 0 and c == a)
            wins[c][1] += sign * m
            wins[c][2] += q / (len(classes) - 1)
    best = max(classes, key=lambda c: (wins[c][0], wins[c][1]))
    return best, float(wins[best][2])


class Predictor:
    """Applies a model to whole texts: the margins are sums of weights over the text's slots."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.keys = {name: list(combinations(classes, 2)) for name, classes in model.children.items()}
        self.tables = {name: np.stack([model.machines[k].weights for k in keys], axis=1) for name, keys in self.keys.items() if keys}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.model.children or not has_letter(text):
            return UNDETERMINED, 0.0
        counts = np.bincount(slots(text), minlength=DIMS)
        used = np.flatnonzero(counts)
        at, share, sure = "", _scaled(counts[used]), 1.0
        while at in self.model.children:
            margin = {}
            if self.keys[at]:
                found = share @ self.tables[at][used]
                margin = {k: float(v) + self.model.machines[k].bias for k, v in zip(self.keys[at], found, strict=True)}
            at, p = _vote(self.model.children[at], margin, self.model.machines)
            sure *= p
        return at, min(1.0, max(0.0, sure))


def fit(docs: DataFrame, train: Column, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Learns from rows where ``train`` holds; at most ``sample`` of them, or one for each label, shared evenly by the labels.

    Rows are chosen by a hash of id and text; only their hashed features come to the driver.
    """
    rows = docs.where(train & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().orderBy(F.desc("count"), label_col).collect()}
    if not counts:
        return NOTHING
    share = max(1, sample // len(counts))
    grain = 1 << 20
    rates = docs.sparkSession.createDataFrame([(k, min(grain, -(-share * grain // n))) for k, n in counts.items()], f"_label {docs.schema[label_col].dataType.simpleString()}, _rate long")
    order = F.xxhash64(F.lit(17), F.col(id_col).cast("string"), F.col(text_col))
    picked = rows.select(F.col(label_col).alias("_label"), order.alias("at"), text_of(text_col).alias("text")).join(F.broadcast(rates), "_label")  # a row for each label
    picked = picked.where(F.pmod("at", F.lit(grain)) < F.col("_rate")).select(F.col("_label").cast("string").alias("lang"), "at", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                n = np.bincount(slots(text), minlength=DIMS) if has_letter(text) else np.zeros(DIMS, np.int64)
                used = np.flatnonzero(n)
                out.append(used.astype("<u2").tobytes() + _scaled(n)[used].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "at", "sparse"])

    found = picked.mapInArrow(features, "lang string, at bigint, sparse binary").where(F.length("sparse") > 0).toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["at"]))
    x, langs, taken = np.zeros((len(found), DIMS), np.float32), [], {}
    for r in found:
        if taken.setdefault(r["lang"], 0) < share:
            taken[r["lang"]] += 1
            n = len(r["sparse"]) // 6
            x[len(langs), np.frombuffer(r["sparse"], "<u2", n)] = np.frombuffer(r["sparse"], "<f4", n, 2 * n)
            langs.append(r["lang"])
    return fit_arrays(x[: len(langs)], langs) if langs else NOTHING


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id, the kept columns, lang_pred, score) of every row; only the text is read by the prediction."""
    source = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text"))
    names = [f.name for f in source.schema[:-1]]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each slot and pair of labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Predictor(sent.value)
        for batch in batches:
            got = [tool.predict(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "lang_pred string, score double"]))
