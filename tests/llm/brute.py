"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def edits_in(pattern, text, most):
    """The least edit distance of ``pattern`` to any part of ``text``, if at most ``most``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) if min(row) <= most else None


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def least_reached(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def jaccard(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = least_reached(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


SECRET = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()]
    twice = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 16 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


PRIVATE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: luhn(m[0])),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= sum(c.isdigit() for c in m[0]) <= 15),
}


def spans(text, kinds, by_start):
    found = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in p.finditer(text or "") if ok(m)]
    found.sort(key=lambda f: (f[0], f[1]) if by_start else (f[1], f[0]))
    return [(k, a, b) for a, _, k, b in found]


def span_digest(found):
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def template(line):
    words = line.translate(str.maketrans("\t\r\f\v", "    ")).strip(" ")
    return tuple("<*>" if re.search("[0-9]", w) else w for w in words.split(" ")) if words else ()


def shared_templates(own, similarity):
    """{template: what it shares with others}; lines without company are left out."""
    out, leaves = {}, [((), own)]
    while leaves:
        name, lines = leaves.pop()
        modes = [max((n, w) for w, n in Counter(t[i] for t in lines).items())[1] for i in range(len(next(iter(lines))))]
        near = {t for t in lines if sum(a == b for a, b in zip(t, modes)) >= similarity * len(modes)}
        if len(near) > 1:
            out |= dict.fromkeys(near, name)
            parts = {0: lines - near}
        else:
            _, at = min((len(kinds), i) for i in range(len(modes)) if len(kinds := {t[i] for t in lines}) > 1)
            parts = defaultdict(set)
            for t in lines:
                parts[t[at]].add(t)
        leaves += [((*name, w), x) for w, x in parts.items() if len(x) > 1]
    return out


def kept_lines(rows, min_tokens=60, similarity=0.8):
    """{id: text} after line deduplication."""
    leaves, places = defaultdict(set), defaultdict(list)
    lines = [(i, p, template(x)) for i, t in rows for p, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    for _, _, t in lines:
        leaves[len(t), t[:3]].add(t)
    group = {}
    for key, own in leaves.items():
        shared = shared_templates(own, similarity) if len(own) > 1 else {}
        group |= {t: ("leaf", key, shared[t]) if t in shared else t for t in own}
    for i, p, t in lines:
        places[group[t], len(t)].append((i, p))
    gone = set()
    for (_, n), where in places.items():
        docs = len({i for i, _ in where})
        if docs >= 2 and docs * n >= min_tokens:
            gone |= set(where) - {min(where)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def disclosing(rows, disclosure=0.8):
    """{term: ratio}: every pair of a term and an entity, counted document by document."""
    words = [{w.lower() for w in re.findall(r"[^\W\d_]+", t or "")} for _, t in rows]
    held = [{f"{k}:{t[a:b].lower()}" for k, a, b in spans(t, PRIVATE, False)} for _, t in rows]
    n, out = len(rows), {}
    df, de = Counter(w for x in words for w in x), Counter(e for x in held for e in x)
    both = Counter((w, e) for x, y in zip(words, held, strict=True) for w in x for e in y)
    for (w, e), c in both.items():
        if n > de[e]:
            ratio = min(1.0, round(math.log2(n * c / (df[w] * de[e])) / math.log2(n / de[e]), 9))
            if ratio >= disclosure:
                out[w] = max(ratio, out.get(w, 0.0))
    return out
