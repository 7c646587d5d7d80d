"""DuckDB SQL for the queries that SQL can express. The others are tested by brute force."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS budget, 2.0::DOUBLE * source_size AS cap
  FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), water AS (
  SELECT min({{'ratio': cap / weight, 'level': level}}) AS least FROM l WHERE level * weight <= cap
), t AS (
  SELECT source, source_size, coalesce(least(cap, water.least.level * weight), cap)::DOUBLE AS target FROM l, water
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS copies FROM t
), u AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN budget <= 0 THEN 0 WHEN upto <= budget THEN 1
                              WHEN upto - own <= budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), r AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), k AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM r
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""

_METRICS = (("symbols", "n_symbols", "word_chars"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"), ("word_length", "word_chars", "n_words"))


def _ratio(a: str, b: str) -> str:
    return f"floor(1000 * {a} / greatest({b}, 1))::BIGINT"


def _value(at: str) -> str:
    shift = f"greatest((({at}) // 16) - 1, 0)"
    return f"((({at}) - {shift} * 16) << {shift})"


QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT row, doc_id, lang, source, regexp_extract_all(t, '{WORD}') AS ws,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), p AS (
  SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a
), three AS (
  SELECT row, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY row ORDER BY i)
), again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w, w2, w3) AS n FROM three WHERE w3 IS NOT NULL) WHERE n > 1
), cover AS (
  SELECT row, count(DISTINCT j)::BIGINT AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY row
), f AS (
  SELECT row, doc_id, lang, source, len(ws)::BIGINT AS n_words, word_chars, n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN cover USING (row)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), m AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {_ratio(x, y)} AS v FROM b WHERE NOT base_failed" for m, x, y in _METRICS)}
), sketch AS (
  SELECT lang, source, metric, greatest(length(bin(v)) - 5, 0) * 16 + (v >> greatest(length(bin(v)) - 5, 0)) AS bucket, count(*)::BIGINT AS n
  FROM m GROUP BY ALL
), every AS (
  SELECT metric, bucket, sum(sum(n)) OVER (PARTITION BY metric ORDER BY bucket) / sum(sum(n)) OVER (PARTITION BY metric) AS share
  FROM sketch GROUP BY metric, bucket
), wide_n AS (
  SELECT l.lang, e.metric, e.bucket, e.share AS prior, coalesce(s.n, 0) AS n
  FROM (SELECT DISTINCT lang FROM b) l CROSS JOIN every e
  LEFT JOIN (SELECT lang, metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL) s ON l.lang IS NOT DISTINCT FROM s.lang AND e.metric = s.metric AND e.bucket = s.bucket
), wide AS (
  SELECT lang, metric, bucket, (sum(n) OVER (PARTITION BY lang, metric ORDER BY bucket) + 5 * prior) / (sum(n) OVER (PARTITION BY lang, metric) + 5) AS share FROM wide_n
), own_n AS (
  SELECT g.lang, g.source, w.metric, w.bucket, w.share AS prior, coalesce(s.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM b) g JOIN wide w ON g.lang IS NOT DISTINCT FROM w.lang
  LEFT JOIN sketch s ON g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source AND w.metric = s.metric AND w.bucket = s.bucket
), own AS (
  SELECT lang, source, metric, bucket, (sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) + 5 * prior) / (sum(n) OVER (PARTITION BY lang, source, metric) + 5) AS share FROM own_n
), reached AS (
  SELECT lang, source, metric, min(CASE WHEN share >= 0.5 THEN bucket END) AS middle, min(CASE WHEN share >= 0.98 THEN bucket END) AS high, min(CASE WHEN share >= 0.98 THEN share END) AS upto FROM own GROUP BY ALL
), fence AS (
  SELECT r.lang, r.source, r.metric, max(high) + 1 AS above, CASE WHEN max(high) = max(middle) THEN min(CASE WHEN share >= (1.0 + upto) / 2 THEN bucket END) END AS half
  FROM reached r JOIN own o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source AND r.metric = o.metric GROUP BY r.lang, r.source, r.metric
), top AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{m}' THEN greatest({_value('above')}, coalesce({_value('half')}, 0)) - 1 END) AS max_{m}" for m, _, _ in _METRICS)}
  FROM fence GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"{_ratio(x, y)} <= max_{m}" for m, x, y in _METRICS)} AS kept
FROM b JOIN top ON b.lang IS NOT DISTINCT FROM top.lang AND b.source IS NOT DISTINCT FROM top.source
"""


def _kind(x: str) -> str:
    x = f"regexp_replace({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '{{date}}', 'g')"
    x = f"regexp_replace({x}, '[0-9a-f]{{16,}}', '{{hex}}', 'g')"
    return f"regexp_replace({x}, '[0-9]+', '{{n}}', 'g')"


def _differs(n: str, bad: str, all_n: str, all_bad: str) -> str:
    n, bad, all_n, all_bad = (f"{c}::DOUBLE" for c in (n, bad, all_n, all_bad))
    return f"(({bad} * ({all_n} - {n}) - ({all_bad} - {bad}) * {n}) ** 2 > 9.0 * ({all_bad} * ({all_n} - {all_bad}) / greatest({all_n}, 1.0) * {n} * ({all_n} - {n})))"


def _urls(levels: int = 6) -> str:
    """The tree down to ``levels`` segments, which are more than any path of the test tables has."""
    slots = " || '|' || ".join(f"coalesce(min(CASE WHEN md5(s[{{i}} + 1])[1] BETWEEN '{a}' AND '{b}' THEN md5(s[{{i}} + 1]) END), '-')" for a, b in ("03", "47", "8b", "cf"))
    steps = []
    for i in range(1, levels + 1):
        steps.append(f"""child{i} AS (
  SELECT host, template, s[{i}] AS key, sum(n) AS c_n, sum(labelled) AS c_l, sum(bad) AS c_b, max(len(s) <= {i})::VARCHAR || '|' || {slots.format(i=i)} AS alike
  FROM leaves{i - 1} WHERE going AND len(s) >= {i} GROUP BY host, template, s[{i}]
), node{i} AS (
  SELECT host, template, count(*) AS m, count(*) FILTER (WHERE c_n = 1) AS once, sum(c_n) AS p_n, sum(c_l) AS p_l, sum(c_b) AS p_b FROM child{i} GROUP BY ALL
), wild{i} AS (
  SELECT *, m >= 20 AND 2 * once >= m AND c_n * 20 < p_n AND NOT (c_l >= 10 AND {_differs("c_l", "c_b", "p_l", "p_b")}) AS wild FROM child{i} JOIN node{i} USING (host, template)
), merged{i} AS (
  SELECT host, template, alike, count(*) AS g, sum(c_l) AS g_l, sum(c_b) AS g_b, min(key) AS first, max(key) AS last FROM wild{i} WHERE NOT wild AND p_l >= 10 GROUP BY ALL
), branch{i} AS (
  SELECT host, template, key, CASE WHEN p_l < 10 THEN '**' WHEN wild THEN '*' WHEN g = 1 OR (c_l >= 10 AND {_differs("c_l", "c_b", "g_l", "g_b")}) THEN key
         ELSE '(' || first || '..' || last || ')' END AS branch
  FROM wild{i} LEFT JOIN merged{i} USING (host, template, alike)
), leaves{i} AS (
  SELECT l.host, l.kind, s, n, labelled, bad, CASE WHEN branch IS NULL THEN l.template ELSE l.template || '/' || branch END AS template, going AND coalesce(branch <> '**', false) AS going
  FROM leaves{i - 1} l LEFT JOIN branch{i} b ON going AND l.host = b.host AND l.template = b.template AND l.s[{i}] = b.key
)""")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    rules.sort(key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True)) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True)) + " END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH x AS (
  SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) = 0 THEN NULL ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM x
), u AS (
  SELECT page_id, host, path, {_kind("path")} AS kind FROM h
), labelled AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), leaves0 AS (
  SELECT host, kind, string_split(regexp_replace(kind, '^/', ''), '/') AS s, count(*) AS n, count(quality) AS labelled, count(*) FILTER (WHERE quality <= 0) AS bad, '' AS template, true AS going
  FROM u LEFT JOIN labelled ON page_id = doc_id GROUP BY host, kind
), {", ".join(steps)}, own AS (
  SELECT host, template, sum(labelled - bad) AS good, sum(labelled) AS labelled FROM leaves{levels} GROUP BY ALL
), hosts AS (
  SELECT host, sum(good) AS good, sum(labelled) AS labelled FROM own GROUP BY host
), every AS (
  SELECT CASE WHEN sum(labelled) > 0 THEN sum(good) / sum(labelled) ELSE 1.0 END::DOUBLE AS p FROM hosts
), priors AS (
  SELECT host, p, (good + 20 * p) / (labelled + 20) AS h_purity FROM hosts, every
), pure AS (
  SELECT own.host, template, labelled, p, h_purity, (good + 10 * h_purity) / (labelled + 10) AS purity FROM own JOIN priors ON own.host = priors.host
), judged AS (
  SELECT l.host, l.kind, purity + 2.0 * sqrt(purity * (1 - purity) / (p.labelled + 10)) < 0.75 * greatest(h_purity, p.p) AS bad
  FROM leaves{levels} l JOIN pure p ON l.host = p.host AND l.template = p.template
)
SELECT page_id, u.host, path, {rule.replace("host", "u.host")} AS rule, coalesce({ruled.replace("host", "u.host")}, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN judged j ON u.host = j.host AND u.kind = j.kind
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = f"""
WITH p AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang
), gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) r(k) WHERE len(w) >= k) GROUP BY ALL
), candidate AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE k > 1 AND f >= 100
), cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate)
), scores AS (
  SELECT c.lang, c.phrase, c.a, j, h.f AS l, t.f AS r, n, (1000 * c.a * n) // (h.f * t.f) AS score
  FROM cuts c JOIN gram h ON c.lang = h.lang AND c.head = h.phrase JOIN gram t ON c.lang = t.lang AND c.tail = t.phrase JOIN totals ON c.lang = totals.lang
), best AS (
  SELECT lang, phrase, a, l, r, n, score FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidate s JOIN (
    SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidate))
  ) b ON s.lang = b.lang AND s.phrase = b.phrase AND 100 * b.a >= 100 * s.a
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept WHERE rank <= 2000
"""

DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS t FROM documents
), w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), c AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0)::HUGEINT AS n
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = kept.term
), s AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM c JOIN v USING (lang)
), base AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM s JOIN base USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

DECONTAMINATION = f"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM i WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT row, k, j, array_to_string(w[j:j + k - 1], ' ') AS x
  FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (
  SELECT row, j, win.k, item FROM places JOIN win USING (k, x)
), covered AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(j, j + k)) AS p FROM (SELECT DISTINCT row, j, k FROM hit)) GROUP BY row
), items AS (
  SELECT row, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
"""


SQL = {
    "op2_url_filters": _urls(), "op8_exact_topk": TOP_K, "op9_quality_rules": QUALITY, "op10_mixing": MIXING,
    "op11_phrases": PHRASES, "op12_divergence": DIVERGENCE, "op13_decontamination": DECONTAMINATION,
}
