"""DuckDB SQL that gives the same rows as the catalogue's queries."""

from __future__ import annotations

from ..functions import fixed_values as V
from ..functions.texts import PUNCTUATION


def _count(low: str, words) -> str:
    return "(" + " + ".join(f"contains({low}, '{w}')::INT" for w in words) + ")"


def _any(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


_LOW = "lower(coalesce(text, ''))"
SCORE = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {_count(_LOW, V.POSITIVE_WORDS)} > {_count(_LOW, V.NEGATIVE_WORDS)} THEN 0.7::DOUBLE + {_count(_LOW, V.POSITIVE_WORDS)} * 0.05::DOUBLE
  WHEN {_count(_LOW, V.NEGATIVE_WORDS)} > {_count(_LOW, V.POSITIVE_WORDS)} THEN 0.3::DOUBLE - {_count(_LOW, V.NEGATIVE_WORDS)} * 0.05::DOUBLE ELSE 0.5::DOUBLE END))"""
POSTS = f"p AS (SELECT doc_id AS seq, source AS platform, lang AS author, text AS content, {SCORE} AS score, 2 * {SCORE} - 1 AS compound FROM documents)"
FACTS = "f AS (SELECT event_id, ts, event_type AS platform, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, (value - 50) / 100)) AS compound FROM events)"
SHARES = """count(*) AS post_count, round(coalesce(avg(compound), 0), 4) AS avg_sentiment, round(count(*) FILTER (WHERE compound > 0.2) / greatest(count(*), 1) * 100, 1) AS positive_pct,
  round(count(*) FILTER (WHERE compound < -0.2) / greatest(count(*), 1) * 100, 1) AS negative_pct, round((count(*) - count(*) FILTER (WHERE compound > 0.2) - count(*) FILTER (WHERE compound < -0.2)) / greatest(count(*), 1) * 100, 1) AS neutral_pct"""
TIMELINE = f"""WITH {FACTS}, t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(compound), 4) AS avg_sentiment, count(*) AS post_count, count(*) FILTER (WHERE compound > 0.2) AS positive,
  count(*) FILTER (WHERE compound < -0.2) AS negative, count(*) FILTER (WHERE compound BETWEEN -0.2 AND 0.2) AS neutral FROM f GROUP BY 1)"""
KEYWORDS = f"{POSTS}, k0 AS (SELECT platform, seq, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{4,}}') AS ks FROM p), k AS (SELECT platform, seq, unnest(ks) AS keyword, generate_subscripts(ks, 1) - 1 AS pos FROM k0)"
LABEL3 = f"CASE WHEN score >= {V.POSITIVE_FROM} THEN 'positive' WHEN score <= {V.NEGATIVE_TO} THEN 'negative' ELSE 'neutral' END"
DIRECTION = "CASE WHEN delta > 0.05 THEN 'improved' WHEN delta < -0.05 THEN 'declined' WHEN delta IS NULL THEN 'stable' ELSE 'stable' END"
CUT = "TIMESTAMP '2024-01-16'"

# --- urls ---
SCHEME = "lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
AUTHORITY = "lower(regexp_extract(trim(url), '^[^:/?#]+://([^/?#]*)', 1))"
PATH = "regexp_extract(trim(url), '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1)"
DOMAIN = f"regexp_replace({AUTHORITY}, '^www\\.', '')"
_BARE = f"regexp_replace(regexp_replace({PATH}, ';[^/]*$', ''), '/+$', '')"
_KEPT = f"list_filter(string_split({QUERY}, '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND NOT list_contains([{', '.join(repr(k) for k in V.TRACKING_KEYS)}], lower(split_part(x, '=', 1))))"
NORMALIZED = f"CASE WHEN {SCHEME} IN ('http', 'https') THEN {SCHEME} || '://' || {AUTHORITY} || CASE WHEN {_BARE} = '' THEN '/' ELSE {_BARE} END || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END ELSE '' END"
PLATFORM = "CASE " + " ".join(f"WHEN {_any(f'ends_with({DOMAIN}, {e!r})' for e in ends)} THEN '{n}'" for n, ends in V.PLATFORM_DOMAINS) + f" WHEN {_any(f'contains({DOMAIN}, {k!r})' for k in V.NEWS_KEYWORDS)} THEN 'news_site' ELSE 'web' END"


def _low_value(source: str) -> str:
    """CTE ``lv`` of a relation with a column url: all its columns and low_value."""
    d, path, low = AUTHORITY, f"lower({PATH})", "lower(url)"
    keys = f"list_transform(string_split({QUERY}, '&'), lambda x: lower(split_part(x, '=', 1)))"
    rule = " OR ".join([
        "url = ''", _any(f"{d} = '{x}' OR ends_with({d}, '.{x}')" for x in V.LOW_VALUE_DOMAINS), _any(f"contains({path}, '{x}')" for x in V.LOW_VALUE_PATHS),
        f"list_has_any({keys}, [{', '.join(repr(k) for k in V.LOW_SIGNAL_KEYS)}])", _any(f"contains({low}, '{x}')" for x in V.LOW_VALUE_PATTERNS), _any(f"ends_with({low}, '{x}')" for x in V.ASSET_ENDINGS),
    ])
    return f"lv AS (SELECT *, ({rule}) AS low_value FROM {source})"


FOLDER = f"regexp_replace({PATH}, '[^/]*$', '')"
_ANCHOR = """(?is)<a\\s[^>]*href=("[^"]*"|''[^'']*'')[^>]*>(.*?)</a>"""
ANCHORS = f"""a0 AS (SELECT page_id, url, regexp_extract_all(html, '{_ANCHOR}', 0) AS found FROM pages),
a1 AS (SELECT page_id, url, unnest(found) AS x, generate_subscripts(found, 1) - 1 AS pos FROM a0),
a2 AS (SELECT page_id, url, pos::BIGINT AS pos, regexp_extract(x, '{_ANCHOR}', 1)[2:-2] AS href, trim(regexp_replace(regexp_replace(regexp_extract(x, '{_ANCHOR}', 2), '<[^>]*>', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS title FROM a1),
a AS (SELECT (page_id * 10000000 + pos)::BIGINT AS seq, page_id, pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN {SCHEME} || ':' || href
  WHEN starts_with(href, '/') THEN {SCHEME} || '://' || {AUTHORITY} || href WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href
  ELSE {SCHEME} || '://' || {AUTHORITY} || CASE WHEN {FOLDER} = '' THEN '/' ELSE {FOLDER} END || href END AS url, title FROM a2)"""
_TITLE = "trim(coalesce(title, ''))"
_REL = f"least(1.0::DOUBLE, 0.15::DOUBLE + {_count('lower(title)', ('the', 'and', 'tion', 'of'))} * 0.12::DOUBLE + {_count('lower(title)', V.EVIDENCE_TERMS)} * 0.04::DOUBLE)"
SIGHTINGS = f"""{ANCHORS}, s0 AS (SELECT seq, page_id, title, pos + 1 AS position, url AS raw, {NORMALIZED} AS url FROM a), {_low_value("s0")},
s1 AS (SELECT seq, page_id, title, position, url AS normalized_url, low_value, raw AS url, {_REL} AS rel, {_count('lower(title)', V.EVIDENCE_TERMS)} AS ev, {_count('lower(title)', V.NEUTRAL_TERMS)} AS ne FROM lv),
s2 AS (SELECT *, {PLATFORM} AS platform, CASE WHEN normalized_url = '' THEN 'invalid_url' WHEN low_value THEN 'low_value_url' WHEN lower({_TITLE}) IN ({', '.join(repr(t) for t in V.LOW_SIGNAL_TITLES)}) THEN 'navigation_link' END AS reason FROM s1),
s AS (SELECT seq, page_id, title, normalized_url, platform, reason, CASE WHEN page_id % 3 = 0 THEN title END AS author,
  round(CASE WHEN reason = 'invalid_url' THEN 0.0::DOUBLE WHEN reason IS NOT NULL THEN 0.05::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.2::DOUBLE + CASE WHEN {_TITLE} <> '' THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + (20 - least(position, 20)) * 0.01::DOUBLE
    + CASE WHEN platform <> 'web' THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + least(0.18::DOUBLE, ev * 0.03::DOUBLE) - least(0.2::DOUBLE, ne * 0.05::DOUBLE) + rel * 0.35::DOUBLE)) END, 6) AS quality,
  round(CASE WHEN reason = 'invalid_url' THEN 0.0::DOUBLE WHEN reason IS NOT NULL THEN 0.05::DOUBLE ELSE rel END, 6) AS relevance FROM s2),
ok AS (SELECT * FROM s WHERE normalized_url <> '' AND quality >= {V.MIN_QUALITY}),
m AS (SELECT normalized_url, min(seq) AS first_seen, max(seq) AS last_seen, (count(*) - 1)::BIGINT AS duplicate_count, arg_max(title, {{'n': length(coalesce(title, '')), 's': -seq}}) AS title, max(quality) AS quality, max(relevance) AS relevance,
  arg_max(page_id, seq) AS last_page, arg_min(author, seq) FILTER (WHERE author IS NOT NULL) AS author FROM ok GROUP BY normalized_url)"""

# --- texts ---
_B = "coalesce(text, '')"
_URLS = "(?i)https?://[^ \\t\\n\\r]+|www\\.[^ \\t\\n\\r]+"


def _features(text: str, source: str) -> str:
    n, toks = f"length({text})", f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+')"
    gone = lambda p: f"length(regexp_replace({text}, '{p}', '', 'g'))"
    return f"""ft AS (SELECT *, {n}::BIGINT AS char_count, len({toks})::BIGINT AS token_count, coalesce(({n} - {gone("\\p{L}")}) / nullif({n}, 0), 0.0) AS alpha_ratio, coalesce(({n} - {gone(_URLS)}) / nullif({n}, 0), 1.0) AS url_ratio,
  coalesce(({gone("[ \\t\\n\\r\\x0B\\f]")} - ({n} - {gone("[\\p{L}\\p{N}]")})) / nullif({n}, 0), 1.0) AS symbol_ratio, len(list_distinct(list_transform({toks}, lambda x: lower(x)))) / greatest(len({toks}), 1) AS unique_token_ratio FROM {source})"""


_Q = "(least(1.0::DOUBLE, token_count / 140.0::DOUBLE) * 0.25::DOUBLE + alpha_ratio * 0.4::DOUBLE + unique_token_ratio * 0.2::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - url_ratio) * 0.1::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - symbol_ratio) * 0.05::DOUBLE)"


def _normalized(text: str) -> str:
    t = f"replace(coalesce({text}, ''), '_', ' ')"
    for old, new in V.CONTRACTIONS:
        t = f"regexp_replace({t}, '(?i){old.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"
    t = f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_])@[A-Za-z0-9_]{{2,64}}', '\\1 @user ', 'g')"
    t = f"regexp_replace({t}, '#([A-Za-z0-9_]+)', ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '{_URLS}', ' <url> ', 'g')"
    for p in V.NOISE_PATTERNS:
        t = f"regexp_replace({t}, '(?i){p}', ' ', 'g')"
    t = f"translate({t}, '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', '{' ' * len(PUNCTUATION)}')"
    return f"lower(trim(regexp_replace({t}, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')))"


CLEAN = f"""c0 AS (SELECT doc_id, lang AS topic, {_normalized("text")} AS whole FROM documents), c1 AS (SELECT doc_id, topic, length(whole) AS clean_chars, trim(substring(whole, 1, {V.MAX_CHARS})) AS cleaned FROM c0),
{_features("cleaned", "c1")}, c AS (SELECT doc_id, topic, cleaned, CASE WHEN clean_chars < {V.MIN_CHARS} THEN 'too_short' ELSE concat_ws(',', CASE WHEN clean_chars > {V.MAX_CHARS} THEN 'truncated' END, CASE WHEN alpha_ratio < {V.MIN_ALPHA} THEN 'low_alpha_ratio' END,
  CASE WHEN url_ratio > {V.MAX_URL} THEN 'high_url_ratio' END, CASE WHEN symbol_ratio > {V.MAX_SYMBOL} THEN 'high_symbol_ratio' END) END AS flags,
  CASE WHEN clean_chars < {V.MIN_CHARS} THEN 'too_short' WHEN alpha_ratio < {V.MIN_ALPHA} OR url_ratio > {V.MAX_URL} OR symbol_ratio > {V.MAX_SYMBOL} THEN 'failed' ELSE 'accepted' END AS status FROM ft)"""
MARKED = f"""{CLEAN}, h AS (SELECT *, CASE WHEN status = 'accepted' AND trim(cleaned) <> '' THEN sha256(cleaned) END AS hash FROM c), d AS (SELECT *, CASE WHEN hash IS NOT NULL THEN min(doc_id) OVER (PARTITION BY topic, hash) END AS first_id FROM h),
k AS (SELECT doc_id, topic, CASE WHEN first_id < doc_id THEN 'duplicate' ELSE status END AS status, CASE WHEN first_id < doc_id THEN first_id END AS duplicate_of FROM d)"""
_DELTA = f"greatest(-0.2::DOUBLE, least(0.2::DOUBLE, ({_count('lower(coalesce(content, $$$$))', ('the', 'and', 'tion'))} - {_count('lower(coalesce(content, $$$$))', ('of', 'eau'))}) * 0.02::DOUBLE))"
_SLUG0 = "regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_ \\t\\n-]', '', 'g'), '[ \\t\\n_]+', '-', 'g')"
_SLUG1 = f"regexp_replace(substring({_SLUG0}, 1, 80), '^-+|-+$', '', 'g')"


def _strip(html: str) -> str:
    tags = "(script|style|noscript|template|svg|iframe)"
    t = f"regexp_replace({html}, '(?is)<{tags}[^>]*>.*?</{tags}>', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{letter}')"
    return f"trim(regexp_replace({t}, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'))"


def _tag(pattern: str) -> str:
    return f"nullif(trim(regexp_extract(html, '{pattern}', 1)), '')"


def _meta(name: str) -> str:
    return _tag(f'(?is)<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"')


_ENDS = "[ \\t\\n\\r\\-•*\"''`]+"
_PHRASE = f"trim(regexp_replace(regexp_replace(p, '^{_ENDS}|{_ENDS}$', '', 'g'), '^[0-9]+[.)]\\s*', ''))"
_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _level(value: str, high: int, medium: int) -> str:
    return f"CASE WHEN {value} <= {high} THEN 'high' WHEN {value} <= {medium} THEN 'medium' ELSE 'low' END"


def _pages(templates: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{t}' || q" for t in templates) + "]"


_WORDS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{4,}')"

SQL = {
    "platform_breakdown": f"WITH {POSTS} SELECT platform, {SHARES} FROM p GROUP BY platform",
    "sentiment_summary": f"WITH {POSTS} SELECT {SHARES} FROM p",
    "daily_timeline": f"{TIMELINE} SELECT * FROM t",
    "timeline_volume_pct": f"{TIMELINE} SELECT day, post_count, round(post_count / max(post_count) OVER () * 100, 1) AS volume_pct FROM t",
    "top_keywords_global": f"WITH {KEYWORDS} SELECT keyword, count(*) AS n FROM k GROUP BY keyword ORDER BY n DESC, min({{'s': seq, 'p': pos}}), keyword LIMIT 10",
    "top_keywords_per_platform": f"WITH {KEYWORDS}, g AS (SELECT platform, keyword, count(*) AS n, min({{'s': seq, 'p': pos}}) AS first FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, first, keyword)::INT AS rank FROM g) SELECT platform, rank, keyword, n FROM r WHERE rank <= 5",
    "extreme_posts": f"WITH {POSTS} SELECT arg_max(seq, {{'c': compound, 's': -seq}}) AS most_positive, arg_min(seq, {{'c': compound, 's': seq}}) AS most_negative FROM p",
    "label_histograms": f"WITH {POSTS} SELECT {LABEL3} AS label, count(*) AS n, 'three' AS scheme FROM p GROUP BY 1 UNION ALL SELECT CASE WHEN compound > 0.3 THEN 'Positive' WHEN compound > 0.1 THEN 'Slightly Positive' WHEN compound > -0.1 THEN 'Neutral' WHEN compound > -0.3 THEN 'Slightly Negative' ELSE 'Negative' END, count(*), 'five' FROM p GROUP BY 1",
    "dominant_class": f"WITH {POSTS}, b AS (SELECT platform, {SHARES} FROM p GROUP BY platform) SELECT platform, CASE WHEN positive_pct > negative_pct AND positive_pct > neutral_pct THEN 'Positive' WHEN negative_pct >= positive_pct AND negative_pct > neutral_pct THEN 'Negative' ELSE 'Neutral' END AS dominant FROM b",
    "dashboard_filter_page": f"WITH {POSTS} SELECT seq, platform, compound FROM p WHERE platform IN ('src0', 'src1', 'src2') AND compound BETWEEN -0.5 AND 1 AND (contains(lower(content), 'the') OR contains(lower(author), 'the')) ORDER BY compound DESC, seq LIMIT 20 OFFSET 20",
    "quick_range_counts": f"WITH {FACTS} SELECT count(*) AS everything, count(*) FILTER (WHERE compound BETWEEN 0.2 AND 1) AS positive, count(*) FILTER (WHERE compound BETWEEN -0.2 AND 0.2) AS neutral, count(*) FILTER (WHERE compound BETWEEN -1 AND -0.2) AS negative FROM f",
    "compare_platforms": f"WITH {FACTS}, b AS (SELECT platform, count(*) AS n, round(avg(compound), 4) AS a FROM f WHERE ts < {CUT} GROUP BY 1), t AS (SELECT platform, count(*) AS n, round(avg(compound), 4) AS a FROM f WHERE ts >= {CUT} GROUP BY 1), j AS (SELECT platform, coalesce(b.n, 0)::BIGINT AS base_posts, coalesce(t.n, 0)::BIGINT AS target_posts, b.a AS base_avg, t.a AS target_avg, round(t.a - b.a, 4) AS delta FROM b FULL JOIN t USING (platform)) SELECT *, {DIRECTION} AS direction FROM j",
    "compare_summary": f"WITH {FACTS}, j AS (SELECT count(*) FILTER (WHERE ts < {CUT}) AS base_posts, count(*) FILTER (WHERE ts >= {CUT}) AS target_posts, round(avg(compound) FILTER (WHERE ts < {CUT}), 4) AS base_avg, round(avg(compound) FILTER (WHERE ts >= {CUT}), 4) AS target_avg FROM f), d AS (SELECT *, round(target_avg - base_avg, 4) AS delta FROM j) SELECT *, {DIRECTION} AS direction FROM d",
    "compare_keywords": f"WITH {KEYWORDS}, b AS (SELECT DISTINCT keyword FROM k WHERE platform = 'src0'), t AS (SELECT DISTINCT keyword FROM k WHERE platform = 'src1') SELECT coalesce(b.keyword, t.keyword) AS keyword, CASE WHEN b.keyword IS NULL THEN 'added' WHEN t.keyword IS NULL THEN 'removed' ELSE 'common' END AS change FROM b FULL JOIN t ON b.keyword = t.keyword",
    "normalize_urls": f"WITH n AS (SELECT page_id, {NORMALIZED} AS normalized_url, {DOMAIN} AS domain FROM pages) SELECT page_id, normalized_url, substring(sha256(normalized_url), 1, 24) AS unique_id, domain FROM n",
    "infer_platforms": f"SELECT {PLATFORM} AS platform, count(*) AS n FROM pages GROUP BY 1",
    "low_value_urls": f"WITH n AS (SELECT page_id, {NORMALIZED} AS url FROM pages), {_low_value('n')} SELECT page_id, low_value FROM lv",
    "backend_plans": f"WITH n AS (SELECT page_id, {PLATFORM} AS platform FROM pages) SELECT page_id, CASE platform {' '.join(f'''WHEN '{p}' THEN '{','.join(b for b in plan if b in V.NATIVE_BACKENDS or b in ('generic_http', 'crawlbase'))}' ''' for p, plan in V.BACKENDS.items())} ELSE 'generic_http,crawlbase' END AS plan FROM n",
    "anchor_edges": f"WITH {ANCHORS} SELECT * FROM a",
    "score_links": f"WITH {SIGHTINGS} SELECT seq, platform, reason, quality, relevance FROM s",
    "link_merge": f"WITH {SIGHTINGS} SELECT * FROM m",
    "link_cap": f"WITH {SIGHTINGS}, f AS (SELECT min(seq) AS first FROM ok GROUP BY normalized_url ORDER BY first LIMIT 500), l AS (SELECT max(first) AS last, count(*) AS n FROM f) SELECT seq, normalized_url FROM ok, l WHERE n < 500 OR seq <= last",
    "scrape_queue_bootstrap": f"WITH n AS (SELECT page_id, {NORMALIZED} AS u FROM pages), k AS (SELECT u FROM n WHERE page_id % 2 = 0) SELECT page_id, substring(sha256(u), 1, 24) AS unique_id FROM n WHERE u NOT IN (SELECT u FROM k)",
    "scrape_queue_topk": f"WITH {SIGHTINGS} SELECT normalized_url, quality, relevance FROM m ORDER BY quality DESC, relevance DESC, first_seen LIMIT {V.MAX_TARGETS}",
    "clean_text_features": f"WITH {_features(_B, 'documents')} SELECT doc_id, char_count, token_count, round(alpha_ratio, 6) AS alpha_ratio, round(url_ratio, 6) AS url_ratio, round(symbol_ratio, 6) AS symbol_ratio, round(unique_token_ratio, 6) AS unique_token_ratio, round(CASE WHEN char_count = 0 THEN 0.0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_Q})) END, 6) AS quality_score FROM ft",
    "clean_text_normalize": f"SELECT doc_id, {_normalized('text')} AS cleaned FROM documents",
    "clean_quality_gates": f"WITH {CLEAN} SELECT doc_id, flags, status FROM c",
    "exact_dedupe": f"WITH {MARKED} SELECT doc_id, status, duplicate_of FROM k",
    "clean_run_stats": f"WITH {MARKED} SELECT topic, count(*) AS documents, {', '.join(f'''count(*) FILTER (WHERE status = '{s}') AS {s}''' for s in ('accepted', 'duplicate', 'too_short', 'failed'))}, count(*) FILTER (WHERE status <> 'failed') AS completed FROM k GROUP BY topic",
    "keyword_adjustment": f"WITH {POSTS} SELECT seq, round(CASE WHEN {_DELTA} = 0 THEN score ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, score + {_DELTA} * 0.3::DOUBLE)) END, 6) AS adjusted FROM p",
    "recovery_budget": f"SELECT doc_id AS seq, CASE WHEN length({_LOW}) <= 10 THEN 0.5::DOUBLE WHEN {_count(_LOW, V.RECOVERY_POSITIVE)} > {_count(_LOW, V.RECOVERY_NEGATIVE)} THEN 0.75::DOUBLE WHEN {_count(_LOW, V.RECOVERY_NEGATIVE)} > {_count(_LOW, V.RECOVERY_POSITIVE)} THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS score FROM documents WHERE length(text) % 3 = 0 ORDER BY doc_id LIMIT 10",
    "sentiment_run_stats": f"WITH {POSTS}, l AS (SELECT score, {LABEL3} AS label FROM p) SELECT count(*) AS analyzed, round(avg(score), 6) AS avg_score, {', '.join(f'''count(*) FILTER (WHERE label = '{x}') AS {x}''' for x in ('positive', 'neutral', 'negative'))} FROM l",
    "model_label_normalize": "SELECT event_id, round(CASE event_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN 0.5 WHEN 6 THEN 0.5 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 60)) END::DOUBLE, 6) AS score FROM events",
    "queue_status_counts": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "latest_run_per_topic": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "status_state_fold": "SELECT user_id, min(ts) AS started_at, arg_max(event_type, {'t': ts, 'e': event_id}) AS status, arg_max(value, {'t': ts, 'e': event_id}) AS last_value, count(*) AS attempts, arg_min(value, {'t': ts, 'e': event_id}) FILTER (WHERE value IS NOT NULL) AS first_value FROM events GROUP BY user_id",
    "doc_reuse_ttl": "SELECT o_orderkey, coalesce(o_orderdate >= max(o_orderdate) OVER () - INTERVAL 7 DAY, false) AS reusable FROM orders",
    "json_props_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS published_at FROM events",
    "session_messages": "SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last_role, arg_min(text, turn) AS opening FROM conversations GROUP BY conv_id",
    "version_swap": "SELECT conv_id, count(*) AS n_versions, max(turn) AS active_version, max(turn) + 1 AS next_version FROM conversations GROUP BY conv_id",
    "qa_sample": "SELECT doc_id FROM documents ORDER BY md5('qa' || doc_id::VARCHAR), doc_id LIMIT 50",
    "ordered_distinct_terms": "WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ts FROM conversations), u AS (SELECT conv_id, turn, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM t), g AS (SELECT conv_id, term, min({'t': turn, 'p': pos}) AS f FROM u GROUP BY ALL) SELECT conv_id, term, f.t AS first_turn, f.p::INT AS first_pos FROM g",
    "slug_ids": f"WITH s AS (SELECT doc_id, CASE WHEN {_SLUG1} = '' THEN 'untitled-topic' ELSE {_SLUG1} END AS slug FROM documents) SELECT doc_id, slug, substring(md5(slug || '-' || doc_id::VARCHAR), 1, 12) AS post_id FROM s",
    "export_csv_rows": f"WITH {POSTS}, w AS (SELECT seq, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM p), f AS (SELECT seq, word, min(i) AS i FROM w GROUP BY ALL), k AS (SELECT seq, string_agg(word, '; ' ORDER BY i) AS keywords FROM f GROUP BY seq) SELECT seq AS id, platform, author, content, round(greatest(compound, 0.0), 4) AS positive, round(greatest(-compound, 0.0), 4) AS negative, round(1 - abs(compound), 4) AS neutral, round(compound, 4) AS compound, coalesce(keywords, '') AS keywords FROM p LEFT JOIN k USING (seq)",
    "published_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 < 8 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS published_at FROM orders",
    "reply_tree_depth": "WITH RECURSIVE r AS (SELECT conv_id, turn, NULL::BIGINT AS parent, 0::BIGINT AS depth FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, r.turn, r.depth + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1) SELECT * FROM r",
    "html_metadata": f"""SELECT page_id, coalesce({_meta("og:title")}, {_meta("twitter:title")}, {_tag("(?is)<title[^>]*>(.*?)</title>")}, {_tag("(?is)<h1[^>]*>(.*?)</h1>")}) AS title, {_tag('(?is)<html[^>]*lang="([^"]*)"')} AS lang, coalesce({_meta("author")}, {_meta("article:author")}) AS author, coalesce({_meta("og:description")}, {_meta("description")}) AS description FROM pages""",
    "stream_daily_window": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "eval_confusion": f"WITH {POSTS} SELECT {LABEL3} AS label, quality, toxic, count(*) AS n FROM p JOIN labels ON seq = doc_id GROUP BY ALL",
    "search_phrases": f"WITH l AS (SELECT conv_id, turn, text, 'topic ' || conv_id::VARCHAR AS topic, list_filter(list_transform(string_split_regex(text, '[,;\\n]+'), lambda p: {_PHRASE}), lambda p: length(p) >= 8 AND lower(p) NOT IN {V.NO_PHRASES}) AS k FROM conversations), u AS (SELECT *, list_filter(k, lambda p, i: list_position(k, p) = i) AS once FROM l) SELECT conv_id, turn, CASE WHEN trim(coalesce(text, ''), {_SPACES}) = '' THEN topic WHEN len(once) > 0 THEN array_to_string(once, '|') ELSE {" || '|' || ".join(f"topic || '{e}'" for e in V.DEFAULT_ENDS)} END AS phrases FROM u",
    "priority_levels": f"WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS i, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority[1:1] WHEN 1 THEN lower(o_orderpriority[3:]) END AS raw FROM orders) SELECT o_orderkey, CASE WHEN try_cast(raw AS DOUBLE) IS NOT NULL THEN {_level('try_cast(raw AS DOUBLE)', 2, 4)} WHEN raw IN ('high', 'medium', 'low') THEN raw ELSE {_level('i', 1, 3)} END AS priority FROM r",
    "search_pages": f"WITH h AS (SELECT p_partkey, replace(url_encode(p_name), '%20', '+') AS q, (['reddit', 'youtube', 'facebook', 'instagram', 'news', 'web'])[p_partkey % 6 + 1] AS hint FROM part), l AS (SELECT p_partkey, CASE hint {' '.join(f"WHEN '{k}' THEN {_pages(t)}" for k, t in V.SEARCH_PAGES.items())} ELSE {_pages(V.ANY_SEARCH_PAGES)} END AS urls FROM h) SELECT p_partkey, (generate_subscripts(urls, 1) - 1)::INT AS pos, unnest(urls) AS url FROM l",
    "content_items": f"WITH c AS (SELECT *, 'https://example.org/' || conv_id::VARCHAR AS normalized_url, nullif(trim(text, {_SPACES}), '') AS body, CASE WHEN turn % 3 = 0 THEN role END AS title FROM conversations), a AS (SELECT *, CASE WHEN turn % 4 IN (0, 2) THEN normalized_url || '#' || turn::VARCHAR END AS url FROM c) SELECT normalized_url, sha256(normalized_url || ':' || coalesce(url, role || ':' || coalesce(title, '') || ':' || coalesce(body, '')[1:160] || ':' || turn::VARCHAR)) AS item_id, turn AS position, role AS kind, url, title, body AS text, body[1:280] AS excerpt, 'score=' || turn::VARCHAR AS metrics, CASE WHEN url IS NOT NULL THEN coalesce(title, url) END AS reference FROM a",
    "document_payloads": f"WITH t AS (SELECT page_id AS doc_id, {NORMALIZED} AS normalized_url, url AS title, {DOMAIN} AS domain, {PLATFORM} AS platform FROM pages) SELECT t.doc_id, normalized_url, sha256(normalized_url) AS normalized_url_hash, CASE WHEN t.doc_id % 3 = 1 AND lang <> '' THEN lang ELSE title END AS title, domain, CASE WHEN t.doc_id % 2 = 0 AND source <> '' THEN source ELSE platform END AS platform, sha256(nullif(trim(text, {_SPACES}), '')) AS content_hash FROM t JOIN documents s ON t.doc_id = s.doc_id",
}
