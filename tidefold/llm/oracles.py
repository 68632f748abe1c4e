"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from tidefold.llm import mixing, url_filter

MIXING = f"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([5, 2, 1],
             CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS weight,
             CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total,
             sum(weight) OVER () AS weights,
             coalesce(sum(cap) OVER u, 0) AS cap_before, coalesce(sum(weight) OVER u, 0) AS weight_before
      FROM w WINDOW u AS (ORDER BY cap / weight, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before) / (weights - weight_before) AS level FROM f),
p AS (SELECT *, CASE WHEN level * weight < cap THEN
             row_number() OVER (ORDER BY cap / weight, source NULLS LAST) END AS place FROM l),
o AS (SELECT *, arg_min(level, place) OVER () AS water FROM p),
t AS (SELECT source, source_size, coalesce(least(cap, water * weight), cap) AS target FROM o),
r AS (SELECT d.*, source_size, target,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size,
            CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM r"""


def _url_filter() -> str:
    def case(value):
        rules = sorted(url_filter.RULES, key=lambda rule: -len(rule[1] + rule[2]))
        return "CASE " + " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'"
            for v, h, p in rules
        ) + " END"

    steps = ["r0 AS (SELECT walk, host, seed AS rank FROM seeds)"]
    for i in range(1, url_filter.STEPS + 1):
        steps.append(f"""r{i} AS (
  SELECT walk, host, CAST(sum(part) AS BIGINT) AS rank FROM (
    SELECT w.walk, w.dst AS host, r.rank * {url_filter.DAMPING_PCT} // (100 * w.degree) AS part
    FROM walks w JOIN r{i - 1} r ON w.walk = r.walk AND w.src = r.host
    UNION ALL SELECT walk, host, seed * {100 - url_filter.DAMPING_PCT} // 100 FROM seeds)
  GROUP BY walk, host)""")
    a_z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH a AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), {a_z}) AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS (SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled FROM b),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html,
  '(?i)href\\s*=\\s*["'']?\\s*[a-z][a-z0-9+.-]*://([^/?#"''\\s<>]+)', 1)), {a_z}) AS dst FROM b WHERE host <> ''),
ties AS (SELECT DISTINCT host AS src, regexp_extract(host, '^[^.]+\\.([^.]+\\..+)$', 1) AS dst FROM b WHERE host <> ''),
edges AS (SELECT DISTINCT src, dst FROM (
  SELECT src, dst FROM links UNION ALL SELECT src, dst FROM ties WHERE dst <> ''
  UNION ALL SELECT dst, src FROM ties WHERE dst <> '') WHERE src <> dst AND dst <> ''),
walks AS (
  SELECT 0 AS walk, src, dst, count(*) OVER (PARTITION BY src) AS degree FROM edges UNION ALL
  SELECT 1, dst, src, count(*) OVER (PARTITION BY dst) FROM edges),
c AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed,
             count(*) FILTER (ruled = 'block') AS blocked FROM j WHERE host <> '' GROUP BY host),
chosen AS (
  SELECT 0 AS walk, host FROM c WHERE allowed > 0 AND allowed * 100 >= pages * {url_filter.SEED_PCT} UNION ALL
  SELECT 1, host FROM c WHERE blocked > 0 AND blocked * 100 >= pages * {url_filter.SEED_PCT}),
seeds AS (SELECT walk, host, {url_filter.UNITS} // count(*) OVER (PARTITION BY walk) AS seed FROM chosen),
{", ".join(steps)},
scores AS (SELECT host, coalesce(sum(rank) FILTER (walk = 0), 0) AS trust,
                  coalesce(sum(rank) FILTER (walk = 1), 0) AS distrust FROM r{url_filter.STEPS} GROUP BY host)
SELECT page_id, j.host, path, rule,
       coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0)
                             AND distrust >= {url_filter.MIN_DISTRUST} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM j LEFT JOIN scores USING (host)"""


FILTER_AUDIT = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
f AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT concat(p.name, q.name, r.name, s.name, u.name) AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM x p, x q, x r, x s, x u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31
   AND (p.bit | q.bit | r.bit | s.bit | u.bit) = 31),
k AS (
  SELECT filter_order, step, bits[step] AS own, CAST(list_sum(list_slice(bits, 1, step)) AS INT) - bits[step] AS earlier
  FROM o, range(1, 6) AS steps(step)),
g AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (fails & (earlier | own) = 0) AS kept,
         sum(n) FILTER (fails & (earlier | own) = own) AS removed,
         sum(n) FILTER (fails & own = own AND fails & earlier <> 0) AS redundant,
         sum(n) FILTER (fails = own) AS unique_fails,
         sum(good) FILTER (fails & (earlier | own) = own) AS good_lost,
         sum(toxic) FILTER (fails & (earlier | own) = own) AS toxic_lost
  FROM t, k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM g"""


# DuckDB has no SHA-1: digests are left to the tests, and the rest compares.
ORACLES = {
    "op2_url_filter": _url_filter(),
    "op8_source_mixing": MIXING,
    "op12_filter_audit": FILTER_AUDIT,
}
