"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from quarry.llm.hosts import RULES as URL_RULES
from quarry.llm.mixing import BLOCK_ROWS, MAX_REPEATS, WEIGHTS
from quarry.llm.quality import RULES


def _quality(alpha: float = 0.05, delta: float = 0.05) -> str:
    risk = alpha / len(RULES)
    cells = " UNION ALL ".join(
        f"SELECT '{r.name}' AS rule, CAST({c!r} AS DOUBLE) AS cutoff, * FROM (SELECT *, {r.score.replace('n_words, 1', 'n_words, 1.0')} AS score FROM base)"
        for r in RULES for c in r.grid)
    cuts = ", ".join(f"max(cutoff) FILTER (rule = '{r.name}') AS cut_{r.name}" for r in RULES)
    over = " OR ".join(f"coalesce({r.score.replace('n_words, 1', 'n_words, 1.0')} > cut_{r.name}, false)" for r in RULES)
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS ws FROM documents),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM
        (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
stats AS (SELECT doc_id, stratum, len(ws)::BIGINT AS n_words,
       coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')))
        - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')))))::BIGINT AS n_dup_lines,
       coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
seen AS (SELECT c.rule, c.cutoff, c.stratum, l.quality, c.score > c.cutoff AS outside,
                ('0x' || substr(md5(CAST(l.doc_id AS VARCHAR)), 1, 8))::BIGINT % 2 AS half
         FROM ({cells}) c JOIN labels l ON l.doc_id = c.doc_id WHERE NOT c.base_failed AND l.quality IS NOT NULL),
tests AS (SELECT stratum, rule, cutoff, count(*) FILTER (half = 1 AND quality = 1) AS n,
       count(*) FILTER (half = 1 AND quality = 1 AND outside) AS k, count(*) FILTER (half = 0 AND quality = 1) AS rank_good,
       count(*) FILTER (half = 0 AND quality = 1 AND outside) AS lost, count(*) FILTER (half = 0 AND quality = 0) AS rank_bad,
       count(*) FILTER (half = 0 AND quality = 0 AND outside) AS caught FROM seen GROUP BY ALL),
p AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
              + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) AS pv FROM tests WHERE n > 0 AND k <= n * {risk!r}),
ok AS (SELECT * FROM p WHERE pv <= {delta!r} / (SELECT count(*) FROM tests) AND caught > 0 AND caught * rank_good > 5 * lost * rank_bad),
best AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule
         ORDER BY caught - 10 * lost DESC, cutoff DESC) AS pos FROM ok) WHERE pos = 1),
cuts AS (SELECT stratum, {cuts} FROM best GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({over}) AS kept
FROM base LEFT JOIN cuts ON base.stratum IS NOT DISTINCT FROM cuts.stratum"""


def mixed_words(seed: int = 5) -> str:
    """What the mix takes of every document. The output shards are draws that SQL does not repeat, so this is no oracle
    of the whole query; tests compare it with the words of the drawn blocks."""
    weights = ", ".join(f"{float(w)!r}::DOUBLE" for w in WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body,
                  len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [{weights}][rank % {len(WEIGHTS)} + 1] AS weight, (source_size * {MAX_REPEATS})::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS pos FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT *, weight * level >= cap AS full_up FROM l),
g AS (SELECT *, (SELECT level FROM f WHERE NOT full_up ORDER BY pos LIMIT 1) AS open_level FROM f),
t AS (SELECT source, source_size, n, rank, CASE WHEN full_up THEN cap ELSE weight * open_level END AS target FROM g),
q AS (SELECT *, least(floor(target / greatest(source_size, 1))::BIGINT, {MAX_REPEATS}) AS passes FROM t),
r AS (SELECT *, target - passes * source_size AS rest FROM q),
k AS (SELECT d.*, r.*, ('0x' || perm[1:8])::BIGINT * n_blocks >> 32 AS block
      FROM (SELECT *, md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || md5(body)) AS perm FROM d) d
      JOIN (SELECT * RENAME (source AS of), ceil(n / {float(BLOCK_ROWS)})::BIGINT AS n_blocks FROM r) r ON d.source IS NOT DISTINCT FROM r.of),
b AS (SELECT rank, block, sum(size) AS words FROM k GROUP BY rank, block),
f2 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY rank ORDER BY md5('{seed + 1}|' || rank || '|' || block)
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM b),
u AS (SELECT k.rank, k.block, k.perm, k.rest, any_value(f2.first) AS first, any_value(f2.words) AS words, any_value(k.size) AS z,
             count(*) AS m FROM k JOIN f2 USING (rank, block) GROUP BY k.rank, k.block, k.perm, k.rest),
c AS (SELECT *, first + coalesce(sum(z * m) OVER (PARTITION BY rank, block ORDER BY perm
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
e AS (SELECT *, CASE WHEN rest <= 0 OR first > rest THEN 0 WHEN first + words <= rest THEN m
                     WHEN z = 0 THEN CASE WHEN before <= rest THEN m ELSE 0 END
                     ELSE greatest(0, least(m, floor((rest - before) / z + 0.5))) END AS given FROM c),
p AS (SELECT k.*, e.given, row_number() OVER (PARTITION BY k.rank, k.perm) AS place FROM k JOIN e USING (rank, block, perm))
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN place <= given THEN 1 ELSE 0 END))::BIGINT AS taken FROM p"""


def _urls(max_bad: float = 0.5, z: float = 1.645) -> str:
    def case(value) -> str:
        out = "NULL"
        for v, host, path in sorted(URL_RULES, key=lambda r: len(r[1]) + len(r[2])):
            out = (f"CASE WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}') "
                   f"THEN '{value((v, host, path))}' ELSE {out} END")
        return out

    def concentration(units: str) -> str:
        p = "least(greatest(prior, 1e-6), 1 - 1e-6)"
        return (f"(SELECT 1 / r - 1 FROM (SELECT least(greatest(CASE WHEN sum(n::DOUBLE * (n - 1)) > 0 THEN "
                f"(sum((k - n * {p}) ** 2 / ({p} * (1 - {p}))) - sum(n)) / sum(n::DOUBLE * (n - 1)) ELSE 0 END, 1e-4), 0.999) AS r FROM {units}))")
    return f"""
WITH parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
keyed AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suf FROM parsed),
hosts AS (SELECT host, domain, suf, count(*) AS n, sum(1 - quality) AS k FROM keyed JOIN labels ON doc_id = page_id
          WHERE quality IS NOT NULL GROUP BY ALL),
doms AS (SELECT domain, suf, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
sufs AS (SELECT suf, sum(n) AS n, sum(k) AS k FROM doms GROUP BY ALL),
tot AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS rate FROM sufs),
s1 AS (SELECT sufs.*, rate AS prior FROM sufs, tot),
s2 AS (SELECT *, (k + {concentration('s1')} * prior) / (n + {concentration('s1')}) AS mean FROM s1),
d1 AS (SELECT doms.*, s2.mean AS prior FROM doms JOIN s2 USING (suf)),
d2 AS (SELECT *, (k + {concentration('d1')} * prior) / (n + {concentration('d1')}) AS mean FROM d1),
h1 AS (SELECT hosts.*, d2.mean AS prior FROM hosts JOIN d2 ON hosts.domain = d2.domain AND hosts.suf = d2.suf),
cc AS (SELECT coalesce({concentration('h1')}, 1) AS c),
judged AS (SELECT page_id, keyed.host, path,
       CASE WHEN h1.host IS NOT NULL THEN h1.k + c * h1.prior ELSE c * coalesce(d2.mean, s2.mean, rate) END AS a,
       CASE WHEN h1.host IS NOT NULL THEN h1.n - h1.k + c * (1 - h1.prior) ELSE c * (1 - coalesce(d2.mean, s2.mean, rate)) END AS b
  FROM keyed CROSS JOIN cc CROSS JOIN tot LEFT JOIN h1 ON keyed.host = h1.host LEFT JOIN d2 ON keyed.domain = d2.domain
  LEFT JOIN s2 ON keyed.suf = s2.suf)
SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, coalesce({case(lambda r: r[0])},
       CASE WHEN a / (a + b) - {z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > {max_bad} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


def _secrets() -> str:
    kinds = (("assign", 1, "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
              "[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8),
             ("access", 2, "AKIA[A-Z0-9]+", 0, 16), ("hex", 3, "[0-9a-f]{32,}", 0, 32), ("live", 4, "[A-Za-z0-9+/_-]{20,}", 0, 20))
    found = " UNION ALL ".join(f"""
SELECT rid, '{kind}' AS kind, {order} AS pos, value, start0 AS s, start0 + length(hit) AS e FROM (
  SELECT rid, hits[i] AS hit, vals[i] AS value,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start0
  FROM (SELECT rid, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals,
           string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE length(value) >= {least}"""
                               for kind, order, pattern, group, least in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
found AS ({found}),
base AS (SELECT * FROM found WHERE kind <> 'live'),
cand AS (SELECT * FROM found WHERE kind = 'live' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
         AND len(list_distinct(string_split(value, ''))) >= 10),
own AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(lang, chr(0)))) AS repos
        FROM cand JOIN d USING (rid) GROUP BY value),
live AS (SELECT c.* FROM cand c JOIN own USING (value) WHERE owners <= 1 AND repos <= 2
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.s <= c.s AND b.e >= c.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM live),
joined AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, pos) FILTER (kind <> 'live'), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, pos) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (rid)"""


def _collocations() -> str:
    return r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \t]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f1 AS (SELECT lang, w[i] AS w1, count(*) AS f FROM spots GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM spots WHERE i + 1 <= len(w) GROUP BY ALL),
f3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM spots WHERE i + 2 <= len(w)
       GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL
                                                  SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
       LEFT JOIN longer g ON g.lang = p.lang AND g.w1 = p.w1 AND g.w2 = p.w2
  WHERE p.f >= 10 AND (g.f IS NULL OR 100 * g.f < 50 * p.f)
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 1, x.f, y.f
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1
       JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 2, x.f, y.f
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2
       JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3),
scored AS (SELECT *, 1000000 * a::HUGEINT * a // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


ORACLE: dict[str, str] = {
    "op2_quality_rules": _quality(),
    "op6_url_filters": _urls(),
    "op8_secret_scans": _secrets(),
    "op13_collocations": _collocations(),
}
