"""SQL of the queries that SQL can tell (DuckDB), each over the whole tables.

op1 needs edit distances of substrings, op3 a schedule with a queue, op4, op9
and op10 fitted models, op8 a codec: tests hold them against brute force.
"""

from __future__ import annotations


def _spans(text: str, pattern: str, kind: str, keep: str = "true") -> str:
    """A list of {s, e, k, m}: leftmost non-overlapping matches, by lengths of matches and gaps.

    The starts are running sums: the list of lengths is folded once per match.
    """
    p = pattern.replace("'", "''")
    m, g = f"regexp_extract_all({text}, '{p}')", f"string_split_regex({text}, '{p}')"
    start = f"coalesce(list_sum(list_transform(({g})[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(({m})[1:i-1], lambda x: length(x))), 0)"
    each = f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': ({start})::BIGINT, 'k': {kind}, 'e': (({start}) + length(({m})[i]))::BIGINT, 'm': ({m})[i]}})"
    return f"list_filter({each}, lambda z: {keep})"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(?:" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?"""
_SECRETS = (
    ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(z.m, '^{_ASSIGN.replace(chr(39), chr(39) * 2)}', '')) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(z.m) >= 20"),
    ("hex", "[0-9a-f]{24,}", "true"),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "true"),
)
_KIND = "['assign', 'access', 'hex', 'pem', 'jwt', 'github']"
_NAMED = "array_to_string(list_transform({0}, lambda z: " + _KIND + "[z.k] || ':' || z.s || ':' || z.e), ',')"

_OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {", ".join(f"{_spans('t', p, str(i), keep)} AS {name}" for i, (name, p, keep) in enumerate(_SECRETS, 1))} FROM d),
a AS (SELECT *, list_sort(assign || access || hex) AS base, list_sort(assign || access || hex || pem || jwt || github) AS every FROM f)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex,
       sha256(coalesce({_NAMED.format("base")}, '')) AS base_sha256, coalesce({_NAMED.format("every")}, '') AS spans
FROM a
"""

def _round(r: int) -> str:
    """One round of the template tree: a template for each leaf, and the rest parted."""
    return rf"""
modes{r} AS (SELECT leaf, i, max({{'c': c, 't': token}}).t AS token FROM (SELECT leaf, i, token, count(*) AS c FROM (SELECT leaf, unnest(range(len(w))) AS i, unnest(w) AS token FROM f{r}) GROUP BY ALL) GROUP BY leaf, i),
mode{r} AS (SELECT leaf, list(token ORDER BY i) AS mode FROM modes{r} GROUP BY leaf),
near{r} AS (SELECT leaf, n, template, w, len(list_filter(list_zip(w, mode), lambda z: z[1] = z[2])) >= 0.8 * n AS near FROM f{r} JOIN mode{r} USING (leaf)),
shared{r} AS (SELECT leaf FROM near{r} WHERE near GROUP BY leaf HAVING count(*) > 1),
taken{r} AS MATERIALIZED (SELECT leaf, n, template FROM near{r} SEMI JOIN shared{r} USING (leaf) WHERE near),
rest{r} AS (SELECT leaf, n, template, w FROM near{r} SEMI JOIN shared{r} USING (leaf) WHERE NOT near),
left{r} AS MATERIALIZED (SELECT leaf, n, template, w FROM near{r} ANTI JOIN shared{r} USING (leaf)),
kinds{r} AS (SELECT leaf, i, count(DISTINCT token) AS kinds FROM (SELECT leaf, unnest(range(len(w))) AS i, unnest(w) AS token FROM left{r}) GROUP BY ALL HAVING count(DISTINCT token) > 1),
by{r} AS (SELECT leaf, min({{'k': kinds, 'i': i}}).i AS i FROM kinds{r} GROUP BY leaf),
next{r} AS (
  SELECT leaf || chr(10) AS leaf, n, template, w FROM rest{r}
  UNION ALL SELECT leaf || chr(10) || w[i + 1] AS leaf, n, template, w FROM left{r} JOIN by{r} USING (leaf)),
f{r + 1} AS MATERIALIZED (SELECT * FROM next{r} QUALIFY count(*) OVER (PARTITION BY leaf) > 1)"""


#: Rounds that the SQL tells; the given tables need fewer.
ROUNDS = 8
_OP5 = rf"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT doc_id, pos, list_transform(string_split(x, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w
  FROM (SELECT doc_id, pos, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' ') AS x FROM l) WHERE x <> ''),
t AS MATERIALIZED (SELECT doc_id, pos, w, array_to_string(w, ' ') AS template, len(w) AS n, len(w) || chr(10) || array_to_string(w[1:3], ' ') AS leaf FROM k),
leaves AS (SELECT leaf FROM t GROUP BY leaf HAVING min(template) < max(template)),
f0 AS MATERIALIZED (SELECT DISTINCT leaf, n, template, w FROM t SEMI JOIN leaves USING (leaf)),
{",".join(_round(r) for r in range(ROUNDS))},
general AS ({" UNION ALL ".join(f"SELECT leaf, n, template FROM taken{r}" for r in range(ROUNDS))}),
named AS MATERIALIZED (
  SELECT doc_id, pos, t.n, CASE WHEN general.template IS NULL THEN 'own ' || t.template ELSE 'leaf ' || general.leaf END AS g
  FROM t LEFT JOIN general ON t.n = general.n AND t.template = general.template),
often AS (
  SELECT g, n, min({{'d': doc_id, 'p': pos}}) AS first FROM named GROUP BY g, n
  HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) * n >= 60),
gone AS (SELECT doc_id, pos FROM named JOIN often USING (g, n) WHERE {{'d': doc_id, 'p': pos}} <> first),
marked AS (SELECT l.doc_id, l.pos, l.line, gone.pos IS NOT NULL AS lost FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos)
SELECT m.doc_id, CASE WHEN any_value(d.text) IS NULL THEN 0 ELSE count(*) END::BIGINT AS n_lines, sum(lost::INT)::BIGINT AS n_dropped,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT lost), '') END AS text
FROM marked m JOIN documents d ON d.doc_id = m.doc_id GROUP BY m.doc_id
"""

_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least_.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ ON least_.a = d.doc_id
"""

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr({d}, length({d}) - j + 1, 1)::INT WHEN substr({d}, length({d}) - j + 1, 1)::INT > 4 THEN substr({d}, length({d}) - j + 1, 1)::INT * 2 - 9 ELSE substr({d}, length({d}) - j + 1, 1)::INT * 2 END)) % 10 = 0"
_DIGITS = "regexp_replace(z.m, '[^0-9]', '', 'g')"
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(z.m, '{_BYTE}(?:\.{_BYTE}){{3}}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN.format(d=_DIGITS)}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
)
_WORDS = "\\p{L}+"
_JOINED = "array_to_string(list_transform({0}, lambda z: z.k || ':' || z.s || ':' || z.e), ',')"

_OP7 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED (SELECT doc_id, t, {", ".join(f"{_spans('t', p, repr(name), keep)} AS {name}" for name, p, keep in _PII)} FROM d),
b AS MATERIALIZED (SELECT *, email || ip || card || phone AS base FROM f),
holds AS MATERIALIZED (SELECT DISTINCT doc_id, x.k || ':' || lower(x.m) AS entity FROM (SELECT doc_id, unnest(base) AS x FROM b)),
words AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(t, '{_WORDS}'), lambda x: lower(x)))) AS term FROM d),
df AS (SELECT term, count(*) AS df FROM words GROUP BY term),
de AS (SELECT entity, count(*) AS de FROM holds GROUP BY entity),
every AS (SELECT count(*) AS n FROM d),
pairs AS (
  SELECT term, entity, any_value(df) AS df, any_value(de) AS de, any_value(n) AS n, count(*) AS n_both
  FROM words JOIN holds USING (doc_id) JOIN df USING (term) JOIN de USING (entity), every
  WHERE n > de AND round(log2(n::DOUBLE / df) / log2(n::DOUBLE / de), 9) >= 0.8 GROUP BY term, entity),
rated AS MATERIALIZED (SELECT DISTINCT term FROM pairs WHERE round(log2(n::DOUBLE * n_both / (df::DOUBLE * de)) / log2(n::DOUBLE / de), 9) >= 0.8),
marked AS (SELECT * FROM d SEMI JOIN (SELECT doc_id FROM words SEMI JOIN rated USING (term)) USING (doc_id)),
steps AS (
  SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g[1:len(m)]) AS g
  FROM (SELECT doc_id, regexp_extract_all(t, '{_WORDS}') AS m, string_split_regex(t, '{_WORDS}') AS g FROM marked)),
spots AS (SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM steps),
hits AS (SELECT doc_id, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM spots SEMI JOIN rated ON lower(spots.m) = rated.term),
free AS (
  SELECT doc_id, s, e FROM hits JOIN b USING (doc_id)
  WHERE len(list_filter(base, lambda z: z.s < e AND s < z.e)) = 0),
terms AS (SELECT doc_id, list({{'s': s, 'e': e, 'k': 'term'}} ORDER BY s, e) AS terms FROM free GROUP BY doc_id)
SELECT doc_id, len(email)::BIGINT AS n_email, len(ip)::BIGINT AS n_ip, len(card)::BIGINT AS n_card, len(phone)::BIGINT AS n_phone,
       sha256(coalesce({_JOINED.format("base")}, '')) AS base_sha256,
       concat_ws(',', nullif({_JOINED.format("base")}, ''), {_JOINED.format("terms")}) AS spans
FROM b LEFT JOIN terms USING (doc_id)
"""

SQL: dict[str, str] = {"op2_secrets": _OP2, "op5_lines": _OP5, "op6_jaccard": _OP6, "op7_pii": _OP7}
