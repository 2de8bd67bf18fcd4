"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quillon.llm import pii, warc

_TEXTS = "SELECT doc_id, coalesce(text, '') AS t FROM documents"


def _spans(kinds: list[tuple[str, ...]]) -> str:
    """(doc_id, ord, kind, start, stop, near) of all matches that pass their test; kinds: (name, pattern, kept, skipped).

    kept: characters of hit that are a span, after those skipped at its beginning; near: texts around the match, up to the next ones of its kind.
    """
    parts = []
    for i, (kind, pattern, kept, *skipped) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {i} AS ord, '{kind}' AS kind, start, start + kept AS stop, near FROM (
 SELECT doc_id, stop - length(hit) + {skipped[0] if skipped else 0} AS start, {kept} AS kept, right(gap, {pii.CONTEXT_CHARS}) || ' ' || left(after, {pii.CONTEXT_CHARS}) AS near FROM (
  SELECT doc_id, hit, gap, after, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
   SELECT doc_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(gaps[2:len(hits) + 1]) AS after, generate_subscripts(hits, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d) WHERE len(hits) > 0))) WHERE kept > 0""")
    return "\nUNION ALL ".join(parts)


def _if(test: str) -> str:
    return f"CASE WHEN {test} THEN length(hit) ELSE 0 END"


def _digest(base: tuple[str, ...], more: str = "") -> str:
    base_list = ", ".join(f"'{k}'" for k in base)
    listed = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in base)
    return f"SELECT d.doc_id, {counts}, sha256(coalesce({listed} FILTER (kind IN ({base_list})), '')) AS base_sha256, coalesce({listed}, '') AS spans{more} FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (length({_DIGITS}) - k) % 2 = 0 THEN CAST({_DIGITS}[k] AS INT) WHEN CAST({_DIGITS}[k] AS INT) > 4 THEN 2 * CAST({_DIGITS}[k] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[k] AS INT) END FOR k IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"
_STEP = "CAST(CAST({0} AS HUGEINT) % 97 AS VARCHAR)"


def _mod97(code: str) -> str:
    number = f"array_to_string([CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END FOR c IN string_split({code}[5:] || {code}[1:4], '')], '')"
    return _STEP.format(f"({_STEP.format(f'({_STEP.format(f'{number}[1:30]')} || {number}[31:60])')} || {number}[61:])") + " = '1'"


_SHORTER = "regexp_replace(hit, ' [A-Z0-9]+$', '')"
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "length(hit)"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _if(r"regexp_matches(hit, '^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$')")),
    ("card", r"[0-9]([\x20-]?[0-9])+", _if(f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}")),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _if(f"length({_DIGITS}) BETWEEN 9 AND 15")),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", "CASE WHEN " + _mod97("replace(hit, ' ', '')") + f" THEN length(hit) WHEN {_SHORTER} <> hit AND " + _mod97(f"replace({_SHORTER}, ' ', '')") + f" THEN length({_SHORTER}) ELSE 0 END"),
]
_SCORE = " ".join(f"WHEN '{r.kind}' THEN {r.base} + CASE WHEN regexp_matches(lower(s.near), '(?:^|[^a-z])(?:{r.context})') THEN {pii.CONTEXT_BONUS} ELSE 0 END" for r in pii.RULES)

OP10 = f"WITH d AS ({_TEXTS}), s AS ({_spans(_PII)})\n" + _digest(pii.BASE, f", coalesce(max(CAST(CASE kind {_SCORE} END AS DOUBLE)), 0.0) AS max_score")

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = [
    ("assign", _ASSIGN, _if("length(regexp_extract(hit, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 6")),
    ("access", "AKIA[A-Z0-9]+", _if("length(hit) >= 20")),
    ("hex", "[0-9a-f]+", _if("length(hit) >= 24")),
    ("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", "length(hit)"),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "length(hit) - CASE WHEN starts_with(hit, 'eyJ') THEN 0 ELSE 1 END", "CASE WHEN starts_with(hit, 'eyJ') THEN 0 ELSE 1 END"),
    ("bearer", "[Bb]earer [A-Za-z0-9._~+/-]{20,}=*", "length(hit)"),
]
OP4 = f"WITH d AS ({_TEXTS}), s AS ({_spans(_SECRETS)})\n" + _digest(("assign", "access", "hex"))

OP3 = r"""WITH sized AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
units AS (SELECT doc_id, source, h, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY ALL),
per AS (SELECT source, CAST(sum(total) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM units GROUP BY source),
level AS (SELECT *, source_size * 3 AS cap, CAST((SELECT sum(source_size) FROM per) - coalesce(sum(source_size * 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
 / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per WINDOW w AS (ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST)),
targets AS (SELECT source, source_size, weight, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM level WHERE level * weight <= cap ORDER BY cap / CAST(weight AS DOUBLE), level LIMIT 1) * weight, cap)) AS target FROM level),
run AS (SELECT u.*, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || h) AS key FROM units u),
upto AS (SELECT r.*, t.source_size, t.target, sum(total) OVER (PARTITION BY r.source ORDER BY key) AS upto FROM run r JOIN targets t ON t.source IS NOT DISTINCT FROM r.source),
epochs AS (SELECT *, (CAST(upto AS BIGINT) + epoch * source_size) / target AS finish FROM upto, (VALUES (0), (1), (2)) e(epoch) WHERE target > 0),
queue AS (SELECT *, sum(total) OVER (ORDER BY finish, key, epoch) AS used FROM epochs),
copies AS (SELECT doc_id, source, h, count(*) AS copies FROM queue WHERE used <= (SELECT sum(total) FROM units) GROUP BY ALL)
SELECT s.doc_id, s.size, u.source_size, u.target, CAST(s.size * coalesce(c.copies, 0) AS BIGINT) AS taken FROM sized s JOIN upto u ON u.doc_id IS NOT DISTINCT FROM s.doc_id AND u.source IS NOT DISTINCT FROM s.source AND u.h = s.h
LEFT JOIN copies c ON c.doc_id IS NOT DISTINCT FROM s.doc_id AND c.source IS NOT DISTINCT FROM s.source AND c.h = s.h"""

OP6 = f"""WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS hex, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, bytes) AS first FROM p)
SELECT page_id, bytes AS payload_bytes, array_to_string([substr('{warc.BASE32}', ((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS INT) >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url, true AS intact FROM f"""

OP8 = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) m ON m.doc_id = d.doc_id"""

_VECTORS = """SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0"""
#: Rows are told apart by their number, so that only a query's own row is left out; shorter vectors count as if filled with zeros.
OP11 = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS nth, * FROM ({_VECTORS})),
s AS (SELECT q.nth, q.vec_id AS query_id, y.vec_id, y.nth AS other, CAST(coalesce(list_sum([q.v[i] * y.v[i] FOR i IN range(1, least(len(q.v), len(y.v)) + 1)]), 0) AS BIGINT) AS score FROM v q JOIN v y ON q.nth <> y.nth WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id NULLS LAST, other) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _kmeans(k: int, rounds: int) -> str:
    far = "list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) FOR i IN range(1, 65)])"
    out = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS nth, * FROM ({_VECTORS} AND len(embedding) = 64))""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id IS NULL, h, v) - 1 AS INT) AS n, v AS c FROM (SELECT vec_id, v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v) QUALIFY n < {k})""",
    ]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT nth, vec_id, v, n AS cluster, far AS distance FROM (SELECT v.nth, v.vec_id, v.v, c.n, CAST({far} AS BIGINT) AS far FROM v CROSS JOIN c{r} c) QUALIFY row_number() OVER (PARTITION BY nth ORDER BY far, n) = 1)""")
        if r < rounds:
            out.append(f"""m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(l.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY cluster) l ON l.cluster = c.n)""")
    return f"""WITH {", ".join(out)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.n = a.cluster"""


OP12 = _kmeans(40, 5)

_LOST = "CAST(sum(CASE WHEN m.mask & o.own <> 0 AND m.mask & o.before = 0 THEN m.{0} ELSE 0 END) AS BIGINT)"
OP13 = rf"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t), lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t) THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > firsts.first THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN firsts ON firsts.t = w.t LEFT JOIN lab ON lab.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
o AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS f, CAST(pow(2, ascii(substr(filter_order, step, 1)) - 65) AS INT) AS own, CAST(coalesce(list_sum([pow(2, ascii(substr(filter_order, i, 1)) - 65) FOR i IN range(1, step)]), 0) AS INT) AS before FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, o.f, CAST(sum(CASE WHEN m.mask & (o.own + o.before) = 0 THEN m.n ELSE 0 END) AS BIGINT) AS kept, {_LOST.format("n")} AS removed, CAST(sum(CASE WHEN m.mask & o.own <> 0 AND m.mask & o.before <> 0 THEN m.n ELSE 0 END) AS BIGINT) AS redundant,
 CAST(sum(CASE WHEN m.mask = o.own THEN m.n ELSE 0 END) AS BIGINT) AS unique_fails, {_LOST.format("good")} AS good_lost, {_LOST.format("toxic")} AS toxic_lost FROM m CROSS JOIN o GROUP BY part, filter_order, step, o.f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

ORACLES = {"op3_mixing": OP3, "op4_secrets": OP4, "op6_warc": OP6, "op8_ngram_join": OP8, "op10_pii": OP10, "op11_knn_join": OP11, "op12_centroids": OP12, "op13_filter_audit": OP13}
