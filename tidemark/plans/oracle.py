"""DuckDB SQL of the registered queries, on the same tables."""

from __future__ import annotations

from tidemark.functions import dictionaries as D
from tidemark.plans import queries as Q


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[ \\t\\n\\r]+'), lambda t: t <> '')"


def tokens(x: str) -> str:
    return f"list_distinct({words(x)})"


def any_word(x: str, found: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_s(w)})" for w in found) + ")"


def first_match(x: str, rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_word(x, found)} THEN {_s(name)}" for name, found in rules) + f" ELSE {_s(other)} END"


def rewritten(x: str, expansions) -> str:
    out = f"lower({x})"
    for phrase, new in expansions:
        out = f"replace({out}, {_s(phrase)}, {_s(new)})"
    return out


def values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(_s(v) if isinstance(v, str) else str(v) for v in r) + ')' for r in rows)}) v({names}))"


QUESTIONS = values([(k, q) for k, q, _, _ in D.QUESTIONS] + Q.MORE_QUESTIONS, "query_id, query")
CORPUS = values(Q.CORPUS_QUESTIONS, "query_id, query")
ASKED = f"(SELECT query_id, query FROM {QUESTIONS} UNION ALL SELECT conv_id * 1000 + turn + 1000000, text FROM conversations WHERE role = 'user')"
POSTINGS = f"postings AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents)"
#: Distinct words of the list w in their order.
ORDERED = "list_filter(w, lambda t, i: list_position(w, t) = i)"
BENCH = f"bench AS (SELECT query_id, query, {ORDERED} AS terms FROM (SELECT item_id AS query_id, text AS query, {words('text')} AS w FROM benchmark))"
NUMBER = "TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT)"
K = "CAST(json_extract_string(props, '$.k') AS INT)"


def hits(queries: str, name: str = "hits") -> str:
    return f"{name} AS (SELECT q.query_id, p.doc_id, count(*) AS hits FROM (SELECT query_id, unnest(terms) AS term FROM {queries}) q JOIN postings p USING (term) GROUP BY ALL)"


def ranked(source: str, k: int, order: str = "hits DESC, doc_id") -> str:
    return f"(SELECT query_id, doc_id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k})"


def synonyms(terms: str) -> str:
    extra = ", ".join(f"CASE WHEN list_has_any({terms}, {[base, *m]!r}) THEN {m!r} ELSE [] END" for base, m in Q.CORPUS_SYNONYMS.items())
    return f"list_distinct(flatten([{terms}, {extra}]))"


def vendor_sql(asked: str | None = None) -> str:
    phrases = values([(0, k, a, v) for k, (a, v) in enumerate(D.PHRASE_VENDORS)], "stage, ord, alias, vendor")
    aliases = values([(2, k, a, v) for k, (a, v) in enumerate(D.ALIAS_VENDORS)], "stage, ord, alias, vendor")
    communities = values([(1, k, a, v) for k, (a, v) in enumerate(D.SUBREDDIT_VENDORS)], "stage, ord, alias, vendor")
    registry = values(Q.CORPUS_VENDORS, "vendor, stage")
    low = f"SELECT query_id, lower(query) AS q FROM {asked}" if asked else f"SELECT query_id, lower(query) AS q FROM {QUESTIONS} UNION ALL SELECT item_id + 1000, lower(text) FROM benchmark"
    return f"""
WITH low AS ({low}),
every AS (
  SELECT query_id, q, stage, ord, vendor FROM low JOIN (SELECT * FROM {phrases} UNION ALL SELECT * FROM {aliases}) n ON contains(q, alias)
  UNION ALL SELECT query_id, q, 0, {len(D.PHRASE_VENDORS)}, 'Ubiquiti' FROM low WHERE list_contains({words('q')}, 'g6')
  UNION ALL SELECT query_id, q, stage, ord, vendor FROM low JOIN {communities} c ON regexp_extract(q, '^\\s*\\[r/(\\w+)\\]', 1) = alias
  UNION ALL SELECT query_id, q, stage, ord, r.vendor FROM (SELECT query_id, q, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS ord FROM (SELECT *, {words("translate(q, '?!', '')")} AS w FROM low)) x JOIN {registry} r ON x.word = r.vendor WHERE length(word) > 3),
rungs AS (SELECT *, CASE WHEN stage = 0 THEN 0 WHEN stage <= 2 THEN 1 ELSE stage END AS rung FROM every),
ladder AS (SELECT *, min(rung) OVER (PARTITION BY query_id) AS first FROM rungs),
scored AS (SELECT *, CASE WHEN rung = 0 THEN 0 WHEN contains(q, lower(vendor)) THEN 0 WHEN stage = 2 THEN 1 ELSE 2 END AS score FROM ladder WHERE rung = first),
best AS (SELECT query_id, vendor, row_number() OVER (PARTITION BY query_id ORDER BY score, stage, ord, vendor) AS r FROM scored)
SELECT query_id, vendor FROM best WHERE r = 1"""


def date_sql() -> str:
    day = Q.RUN_DATE
    from datetime import timedelta

    out = "CASE " + " ".join(f"WHEN contains(q, {_s(w)}) THEN {_s((day - timedelta(days=n)).strftime('%Y%m%d'))}" for w, n in D.RELATIVE_DATES)
    for name, number in D.MONTHS:
        a, b = rf"{name}\s*(\d{{1,2}})(?:st|nd|rd|th)?[,\s]+(\d{{4}})", rf"{name}[,\s]+(\d{{4}})"
        out += f" WHEN regexp_matches(q, '{a}') THEN regexp_extract(q, '{a}', 2) || '{number:02d}' || lpad(regexp_extract(q, '{a}', 1), 2, '0')"
        out += f" WHEN regexp_matches(q, '{b}') THEN regexp_extract(q, '{b}', 1) || '{number:02d}01'"
    out += r" WHEN regexp_matches(q, '(\d{4})-(\d{2})-(\d{2})') THEN replace(regexp_extract(q, '\d{4}-\d{2}-\d{2}', 0), '-', '') WHEN regexp_matches(q, '\b(20\d{6})\b') THEN regexp_extract(q, '\b(20\d{6})\b', 1) END"
    return f"SELECT query_id, {out} AS target FROM (SELECT query_id, lower(query) AS q FROM {QUESTIONS})"


RESULTS = f"""{POSTINGS}, {BENCH}, asked AS (SELECT query_id, query, terms FROM bench UNION ALL SELECT -query_id, query, {tokens('query')} FROM {CORPUS}), {hits('asked')},
best AS {ranked('hits', 4)},
results AS (
  SELECT a.query_id, a.query, r.source, r.text FROM asked a LEFT JOIN (
    SELECT query_id, CASE WHEN {NUMBER} <= 2 THEN 'vendor_releases' WHEN {NUMBER} <= 4 THEN 'vendor_reddit' WHEN {NUMBER} <= 6 THEN 'apple_rss' WHEN {NUMBER} <= 8 THEN 'cve' ELSE 'local' END AS source, text
    FROM best JOIN documents USING (doc_id)) r USING (query_id))"""
_FEEDS = ", ".join(map(_s, D.FEEDS))
_TIER1 = ", ".join(map(_s, D.TIER1))
QUALITY = f"""
WITH {RESULTS},
scored AS (
  SELECT query_id, source, len({tokens('query')}) AS n,
         h + CASE WHEN source IN ({_FEEDS}) AND h >= 1 THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), lower(query)[1:20]) THEN 5 ELSE 0 END AS hits
  FROM (SELECT *, len(list_intersect({tokens('query')}, {tokens('text')})) AS h FROM results)),
by_query AS (
  SELECT query_id, max(CASE WHEN source IS NOT NULL THEN hits END) AS best, max(n) AS n, coalesce(bool_or(source IN ({_FEEDS})), false) AS feed,
         coalesce(bool_or(source = 'vendor_releases'), false) AS releases, coalesce(bool_or(source = 'vendor_reddit'), false) AS posts, coalesce(bool_or(source IN ({_TIER1})), false) AS tier1
  FROM scored GROUP BY query_id),
based AS (SELECT *, coalesce(least(best / greatest(n, 1), 1.0), 0.0) AS b FROM by_query),
lifted AS (SELECT *, CASE WHEN feed THEN greatest(b, 0.3) ELSE b END AS c FROM based),
done AS (SELECT query_id, CAST(CASE WHEN releases AND posts THEN greatest(c, 0.65) WHEN releases OR posts THEN greatest(c, 0.5) WHEN tier1 THEN greatest(c, 0.3) ELSE c END AS DOUBLE) AS quality FROM lifted)
SELECT query_id, quality, quality >= 0.15 AS positive FROM done"""
RANKINGS = f"""{POSTINGS}, {BENCH}, shorter AS (SELECT query_id, terms[1:6] AS terms FROM bench), {hits('bench', 'hits_a')}, {hits('shorter', 'hits_b')},
rankings AS (SELECT query_id, doc_id, rank, 'tokens' AS system FROM {ranked('hits_a', 6)} UNION ALL SELECT query_id, doc_id, rank, 'short' FROM {ranked('hits_b', 6)}),
grades AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade FROM labels),
judged AS (SELECT query_id, doc_id, grade FROM (SELECT DISTINCT query_id, doc_id FROM rankings) JOIN grades USING (doc_id))"""


def _gain(grade: str, rank: str) -> str:
    return f"(pow(2.0, {grade}) - 1) / log2({rank} + 1.0)"


def _metrics() -> str:
    per = ", ".join(f"count(*) FILTER (grade >= 1 AND rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN {_gain('grade', 'rank')} ELSE 0 END) AS d{k}" for k in (1, 3, 5))
    ideal = ", ".join(f"sum(CASE WHEN r <= {k} THEN {_gain('grade', 'r')} ELSE 0 END) AS i{k}" for k in (1, 3, 5))
    out = ", ".join(
        f"CASE WHEN hit THEN CASE WHEN coalesce(relevant, 0) > 0 THEN least(h{k} / relevant, 1.0) ELSE 0.0 END END AS recall_{k}, CASE WHEN hit THEN h{k} / {k}.0 END AS precision_{k}, CASE WHEN hit THEN CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0.0 END END AS ndcg_{k}"
        for k in (1, 3, 5)
    )
    return f"""{RANKINGS},
seen AS (SELECT r.*, coalesce(j.grade, 0) AS grade FROM rankings r LEFT JOIN judged j USING (query_id, doc_id)),
got AS (SELECT query_id, system, true AS hit, min(CASE WHEN grade >= 1 THEN rank END) AS first, {per} FROM seen GROUP BY ALL),
ideal AS (SELECT query_id, count(*) FILTER (grade >= 1) AS relevant, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM judged) GROUP BY query_id),
wanted AS (SELECT query_id, system FROM (SELECT query_id FROM bench UNION ALL SELECT -1) CROSS JOIN (VALUES ('tokens'), ('short')) s(system)),
metrics AS (SELECT query_id, system, CASE WHEN hit THEN coalesce(1.0 / first, 0.0) END AS mrr, {out} FROM wanted LEFT JOIN got USING (query_id, system) LEFT JOIN ideal USING (query_id))"""


METRICS = _metrics()


def _long(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT query_id, system, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM metrics" for n in names)


_REWRITTEN = rewritten("query", D.EXPANSIONS)
MEMORY = f"""rows AS (SELECT query_id, query FROM {QUESTIONS} UNION ALL SELECT item_id + 1000, text FROM benchmark),
steps AS (SELECT query_id, query, {_REWRITTEN} || ' ' || array_to_string(list_transform({words('query')}[1:2], lambda w: 're' || w), ' ') AS rewritten, length(query) % 10 / 10.0 AS quality FROM rows),
deltas AS (SELECT query_id, unnest(list_filter({tokens('rewritten')}, lambda t: length(t) > 3 AND regexp_full_match(t, '[a-z]+') AND NOT list_contains({tokens('query')}, t))) AS term, CAST(quality - 0.3 AS DOUBLE) AS delta FROM steps)"""


def _fallback() -> str:
    at, parts = "lower(query)", []
    for phrase, new in D.SHORT_EXPANSIONS:
        parts.append(f"CASE WHEN contains({at}, {_s(phrase)}) THEN {_s(phrase)} END")
        at = f"replace({at}, {_s(phrase)}, {_s(new)})"
    applied = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    return f"""SELECT query_id, trim(CASE WHEN len(applied) > 0 THEN {at} ELSE query || {_s(D.GENERIC_SUFFIX)} END) AS rewritten, CASE WHEN len(applied) > 0 THEN array_to_string(applied, ',') ELSE 'generic' END AS applied
FROM (SELECT query_id, query, {applied} AS applied FROM (SELECT query_id, query FROM {QUESTIONS} UNION ALL SELECT item_id, text FROM benchmark))"""


def _coverage() -> str:
    total, share = "(docs_en + docs_de + docs_fr)", lambda x: f"(matched_{x} / greatest(n, 1))"
    pieces = ", ".join(f"coalesce(max(CASE WHEN lang = '{x}' THEN matched END), 0) AS matched_{x}, coalesce(max(CASE WHEN lang = '{x}' THEN docs END), 0) AS docs_{x}" for x in ("en", "de", "fr"))
    v = lambda a, b: f"least({a} * least({total} / 8.0, 1.0) + {b} * least({share('en')}, 1.0) + 0.25 * least({share('de')}, 1.0) + 0.15 * least({share('fr')}, 1.0), 1.0)"
    return f"""WITH q AS (SELECT query_id, {tokens('query')} AS terms FROM {CORPUS}),
found AS (SELECT query_id, lang, term, count(*) FILTER (contains(lower(text), term)) AS n FROM (SELECT query_id, unnest({synonyms('terms')}) AS term FROM q) x CROSS JOIN documents GROUP BY ALL),
by_lang AS (SELECT query_id, lang, count(*) FILTER (n > 0) AS matched, max(n) AS docs FROM found GROUP BY ALL),
wide AS (SELECT query_id, {pieces} FROM by_lang GROUP BY query_id)
SELECT query_id, CAST(least(0.4 * least({total} / 10.0, 1.0) + 0.3 * {share('en')} + 0.2 * {share('de')} + CASE WHEN docs_fr > 0 THEN 0.1 ELSE 0.0 END, 1.0) AS DOUBLE) AS v1, CAST({v(0.25, 0.35)} AS DOUBLE) AS v2, CAST({v(0.20, 0.40)} AS DOUBLE) AS v3
FROM wide JOIN (SELECT query_id, len(terms) AS n FROM q) USING (query_id)"""


def _routing() -> str:
    cases = " ".join(f"WHEN {any_word('query', found)} THEN {to[:2]!r}" for found, to in D.SUBREDDITS)
    return f"SELECT query_id, unnest(range(0, 2)) AS pos, unnest(CASE {cases} ELSE {D.OTHER_SUBREDDITS[:2]!r} END) AS subreddit FROM {QUESTIONS}"


_BARE = "regexp_replace(t, '^[?!.,]+|[?!.,]+$', '', 'g')"
_BROAD = tokens("query || ' the und que software release'")
_ATTEMPTS = f"""{POSTINGS}, {BENCH}, broad AS (SELECT query_id, {_BROAD} AS terms FROM bench), {hits('bench', 'h1')}, {hits('broad', 'h2')},
attempts AS (
  SELECT b.query_id, coalesce(x.hits / len(b.terms), 0.0) AS first, coalesce(y.hits / len(c.terms), 0.0) AS second
  FROM bench b JOIN broad c USING (query_id) LEFT JOIN {ranked('h1', 1)} x USING (query_id) LEFT JOIN {ranked('h2', 1)} y USING (query_id))"""

SQL = {
    "lexical_topk": f"WITH {POSTINGS}, {BENCH}, {hits('bench')} SELECT * FROM {ranked('hits', 4)}",
    "lexical_topk_nofilter": f"WITH {POSTINGS}, {BENCH}, {hits('bench')}, every AS (SELECT b.query_id, d.doc_id, coalesce(h.hits, 0) AS hits FROM bench b CROSS JOIN documents d LEFT JOIN hits h ON h.query_id = b.query_id AND h.doc_id = d.doc_id) SELECT * FROM {ranked('every', 5)}",
    "topk_with_fallback": f"WITH {POSTINGS}, {BENCH}, q AS (SELECT query_id, terms FROM bench UNION ALL SELECT -query_id, {tokens('query')} AS terms FROM {CORPUS}), {hits('q')}, best AS {ranked('hits', 4)} SELECT * FROM best UNION ALL SELECT query_id, doc_id, 0, rank FROM (SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM best)) CROSS JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents ORDER BY doc_id LIMIT 4)",
    "synonym_expand_topk": f"WITH {POSTINGS}, q AS (SELECT query_id, {synonyms(tokens('query'))} AS terms FROM {CORPUS}), {hits('q')} SELECT * FROM {ranked('hits', 5)}",
    "substr_hits_topk": f"WITH {BENCH}, hits AS (SELECT query_id, doc_id, len(list_filter(terms, lambda t: contains(low, t))) AS hits FROM bench CROSS JOIN (SELECT doc_id, lower(text) AS low FROM documents)) , found AS (SELECT * FROM hits WHERE hits >= 2) SELECT * FROM {ranked('found', 5)}",
    "hybrid_hits_topk": f"WITH q AS (SELECT query_id, {tokens('query')} AS terms FROM {values([(1, 'en version'), (2, 'src1 license fr'), (3, 'de release und')], 'query_id, query')}), hits AS (SELECT query_id, doc_id, len(list_intersect(terms, [source, lang])) + len(list_filter(terms, lambda t: contains(lower(text), t))) AS hits FROM q CROSS JOIN documents) , found AS (SELECT * FROM hits WHERE hits > 0) SELECT * FROM {ranked('found', 5)}",
    "rerank_overlap": f"WITH {POSTINGS}, {BENCH}, {hits('bench')}, best AS {ranked('hits', 8)}, scored AS (SELECT b.query_id, b.doc_id, b.rank, len(list_intersect(q.terms, d.title)) / greatest(len(q.terms), 1) AS score FROM best b JOIN bench q USING (query_id) JOIN (SELECT doc_id, {ORDERED} AS title FROM (SELECT doc_id, {words('string_split(text, chr(10))[1]')} AS w FROM documents)) d USING (doc_id)) SELECT query_id, doc_id, score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM scored) WHERE new_rank <= 4",
    "rewrite_chain": f"SELECT query_id, query, {_REWRITTEN} AS rewritten FROM (SELECT query_id, query FROM {QUESTIONS} UNION ALL SELECT item_id, text FROM benchmark)",
    "rewrite_fallback": _fallback(),
    "categorize_docs": f"SELECT id, {first_match('text', D.CATEGORIES, 'general')} AS category FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -query_id, query FROM {QUESTIONS})",
    "signal_bucket": "SELECT event_id, CASE WHEN q >= 0.7 THEN 'excellent' WHEN q >= 0.5 THEN 'positive' WHEN q >= 0.3 THEN 'acceptable' ELSE 'negative' END AS signal, CASE WHEN q >= 0.5 THEN 'HIGH' WHEN q >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT event_id, value / 100 AS q FROM events)",
    "query_type": f"SELECT query_id, {first_match('query', D.QUERY_TYPES, 'default')} AS kind FROM {ASKED}",
    "task_router": f"SELECT query_id, {first_match('query', D.AGENTS, 'ResearchAgent')} AS agent FROM {ASKED}",
    "subreddit_routing": _routing(),
    "tier_label": f"SELECT doc_id, source, tier, CASE tier WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'COMMUNITY' ELSE 'UNVERIFIED' END AS label FROM (SELECT doc_id, source, CASE WHEN {NUMBER} <= 6 THEN 1 WHEN {NUMBER} <= 11 THEN 2 ELSE 3 END AS tier FROM documents)",
    "subreddit_tag_extract": f"SELECT query_id, lower(regexp_extract(query, '\\[r/(\\w+)\\]', 1)) AS tag FROM {ASKED} UNION ALL SELECT -page_id, lower(regexp_extract(url, '://[^/]+/(\\w+)', 1)) FROM pages",
    "doc_id_hash": "SELECT page_id, sha1(coalesce(nullif(url, ''), regexp_extract(html, '<title>([^<]*)</title>', 1) || '|web'))[1:12] AS hash FROM pages",
    "page_title_extract": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages",
    "json_prop_filter": f"SELECT event_id, event_type, {K} AS k FROM events WHERE {K} >= 90",
    "keyword_extract": f"SELECT query_id, array_to_string({ORDERED}[1:8], ' ') AS keywords, array_to_string(list_transform(list_filter({words('query')}, lambda t: length(t) > 3), lambda t: {_BARE}), ' ') AS long_terms FROM (SELECT item_id AS query_id, text AS query, list_filter(list_transform({words('text')}, lambda t: {_BARE}), lambda t: length(t) > 2 AND t NOT IN {Q.STOP_WORDS!r}) AS w FROM benchmark)",
    "vendor_extract": vendor_sql(),
    "date_extract": date_sql(),
    "asof_release": "WITH p AS (SELECT event_id AS release_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT e.event_id, e.user_id, (SELECT arg_max(release_id, (p.ts, release_id)) FROM p WHERE p.user_id = e.user_id AND p.ts <= e.ts) AS release_id FROM events e WHERE event_type = 'error'",
    "canonical_sort": "WITH first AS (SELECT p_partkey, p_retailprice, CASE WHEN contains(lower(p_brand), 'widget') OR contains(lower(p_name), 'widget') THEN 0 WHEN lower(p_brand) = 'brand#1' THEN 1 WHEN p_size > 40 THEN 3 ELSE 2 END AS class FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) SELECT p_partkey, class, row_number() OVER (ORDER BY class, p_retailprice DESC, p_partkey) AS position FROM first",
    "community_rerank": "WITH first AS (SELECT doc_id, n_chars, contains(low, 'the')::INT + contains(low, 'und')::INT + contains(low, 'que')::INT + contains(low, 'version')::INT + CASE WHEN contains(low[1:80], 'the ') THEN 10 ELSE 0 END AS relevance FROM (SELECT *, lower(text) AS low FROM documents) ORDER BY relevance DESC, doc_id LIMIT 20) SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM first",
    "top_comment": "WITH best AS (SELECT conv_id, length(text) AS votes, text FROM conversations WHERE role = 'assistant' AND length(text) > 10 AND trim(text) NOT IN ('', '[deleted]', '[removed]') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, text DESC) = 1), own AS (SELECT conv_id, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1) SELECT conv_id, coalesce(b.votes, 0) AS votes, CASE WHEN b.votes > 0 THEN 'TOP: ' || b.text ELSE o.text END AS comment FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN best b USING (conv_id) LEFT JOIN own o USING (conv_id)",
    "tier_boost_merge": f"WITH t AS (SELECT lang AS query_id, doc_id, CASE WHEN {NUMBER} <= 6 THEN 1 WHEN {NUMBER} <= 11 THEN 2 ELSE 3 END AS tier, {NUMBER} AS source_ord, {any_word('string_split(text, chr(10))[1]', ['that', 'und ', 'que '])}::INT AS boosted FROM documents) SELECT query_id, doc_id, tier, boosted, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, tier, source_ord, doc_id) AS rank FROM t WHERE tier <= 2) WHERE rank <= 4",
    "conditional_sources": f"WITH {POSTINGS}, q AS (SELECT query_id, {tokens('query')} AS terms FROM {CORPUS}), {hits('q')}, near AS (SELECT h.* FROM hits h JOIN documents USING (doc_id) WHERE {NUMBER} <= 1 AND lang = 'es'), targeted AS {ranked('near', 3)}, rest AS (SELECT * FROM hits WHERE query_id NOT IN (SELECT query_id FROM targeted)) SELECT *, 'targeted' AS origin FROM targeted UNION ALL SELECT *, 'general' FROM {ranked('rest', 3)}",
    "context_drop": f"SELECT query_id, count(*) AS n_context FROM {QUESTIONS} CROSS JOIN documents WHERE {any_word('text', ['version', 'license', 'release'])} AND ({any_word('query', D.SECURITY_WORDS)} OR NOT contains(lower(text), 'license')) GROUP BY query_id",
    "trending_topn": f"WITH s AS (SELECT event_id, value / 500 * 10 + {K} * 0.5::DOUBLE + value * 0.1::DOUBLE + CASE WHEN event_type IN ('error', 'signup') THEN 5 ELSE 0 END + CASE WHEN {K} > 5 THEN 3 ELSE 0 END + CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 2 ELSE 0 END - CASE WHEN user_id % 3 = 0 AND value < 5 THEN 5 ELSE 0 END AS score FROM events) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, event_id LIMIT 50",
    "divergence_topn": "WITH c AS (SELECT conv_id, avg(length(text)) FILTER (role = 'user') AS author, avg(length(text)) FILTER (role = 'assistant') AS community FROM conversations GROUP BY conv_id), g AS (SELECT conv_id, abs(author - community) / greatest(author, community) AS divergence FROM c) SELECT conv_id, divergence, CASE WHEN divergence > 0.3 THEN 'strong' ELSE 'weak' END AS meaning FROM g WHERE divergence IS NOT NULL ORDER BY divergence DESC, conv_id LIMIT 10",
    "quality_floor": QUALITY,
    "weighted_coverage": _coverage(),
    "volume_score": "SELECT source, lang, least(count(*) / 15.0::DOUBLE, 1.0) AS score, least(count(*) / 15.0::DOUBLE, 1.0) >= 0.3 AS positive FROM documents GROUP BY ALL",
    "retry_keep_best": f"WITH {_ATTEMPTS} SELECT query_id, first < 0.75 AS retried, CASE WHEN first < 0.75 THEN greatest(first, second) ELSE first END AS kept, CASE WHEN first < 0.75 THEN second ELSE first END AS replaced FROM attempts",
    "exactness_rubric": f"SELECT event_id, CAST(CASE WHEN k % 5 = 0 THEN 1.0 WHEN k % 2 = 0 AND k % 3 = 0 THEN 0.6 WHEN k % 2 = 0 OR k % 3 = 0 THEN 0.35 ELSE 0.1 END AS DOUBLE) AS quality FROM (SELECT event_id, {K} AS k FROM events)",
    "sentiment_by_group": "SELECT user_id, mean, n, CASE WHEN mean >= 0.05 THEN 'positive' WHEN mean <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT user_id, avg(CASE WHEN event_type = 'error' THEN -value ELSE value END / 500) AS mean, count(*) AS n FROM events GROUP BY user_id)",
    "defect_vs_usability": f"SELECT category, count(*) AS n, avg(length(text)) AS avg_len, avg(n_chars) AS avg_chars FROM (SELECT text, n_chars, 'defect' AS category FROM documents WHERE {any_word('text', [*D.DEFECT_WORDS, 'the'])} UNION ALL SELECT text, n_chars, 'usability' FROM documents WHERE {any_word('text', [*D.USABILITY_WORDS, 'que'])}) GROUP BY category",
    "dataset_overview": "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT source))[1:10], ',') AS first_sources FROM documents LEFT JOIN labels USING (doc_id)",
    "usage_rollup": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(value) / 3600 AS hours_on, sum(value) / 86400 * 100 AS pct_on, 86400 - sum(value) AS seconds_off FROM events GROUP BY ALL",
    "period_stats": "SELECT sum(total) AS total, avg(total) AS per_day, arg_max(day, total) AS peak, arg_min(day, total) AS low FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) AS total FROM events GROUP BY ALL)",
    "ir_metrics": f"WITH {METRICS} SELECT * FROM metrics",
    "pooled_qrels": f"WITH {RANKINGS} SELECT query_id, doc_id, system, rank, grade IS NULL AS to_judge FROM (SELECT * FROM rankings QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY CASE system WHEN 'tokens' THEN 0 ELSE 1 END) = 1) LEFT JOIN grades USING (doc_id)",
    "mean_ci_by_system": f"WITH {METRICS}, long AS ({_long(['mrr', 'recall_3', 'precision_3', 'ndcg_3'])}) SELECT system, metric, avg(value) AS mean, CASE WHEN count(value) < 2 THEN 0.0 ELSE 1.96 * stddev_samp(value) / sqrt(count(value)) END AS ci95, count(value) AS n FROM long GROUP BY ALL",
    "grouping_sets_report": "SELECT event_type, user_id, avg(value) AS mean, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id))",
    "metric_pivot": f"WITH {METRICS} SELECT system, avg(CAST(mrr AS DOUBLE)) AS mrr, avg(ndcg_1) AS ndcg_1, avg(ndcg_3) AS ndcg_3, avg(ndcg_5) AS ndcg_5 FROM metrics GROUP BY system",
    "paired_comparison": f"WITH {METRICS}, p AS (SELECT query_id % 4 AS category, max(CASE WHEN system = 'short' THEN ndcg_3 END) AS b, max(CASE WHEN system = 'tokens' THEN ndcg_3 END) AS t FROM metrics GROUP BY query_id) SELECT category, count(*) AS n, avg(b) AS mean_baseline, avg(t) AS mean_treated, (avg(t) - avg(b)) / greatest(avg(b), 0.001) * 100 AS improvement_pct, count(*) FILTER (t > b + 0.01) AS n_better, count(*) FILTER (t - b > 1e-9) AS helped, count(*) FILTER (b - t > 1e-9) AS hurt, count(*) FILTER (abs(b - t) <= 1e-9) AS tied FROM p GROUP BY category",
    "tertile_gain": "WITH e AS (SELECT row_number() OVER (ORDER BY event_id) AS seq, value, count(*) OVER () AS total FROM events WHERE event_type = 'purchase'), m AS (SELECT max(greatest(total // 3, 1)) AS part, avg(value) FILTER (seq <= greatest(total // 3, 1)) AS early, avg(value) FILTER (seq > total - greatest(total // 3, 1)) AS late FROM e) SELECT part, early, late, (late - early) / greatest(early, 0.001) * 100 AS gain_pct FROM m",
    "memory_scores": f"WITH {MEMORY} SELECT query_id, term, delta, sum(delta) OVER (PARTITION BY term ORDER BY query_id ROWS UNBOUNDED PRECEDING) AS score FROM deltas",
    "memory_best": f"WITH {MEMORY} SELECT term, sum(delta) AS score FROM deltas GROUP BY term ORDER BY round(score, 9) DESC, term LIMIT 10",
    "memory_curve": f"WITH {MEMORY}, new AS (SELECT query_id, count(*) AS new FROM (SELECT min(query_id) AS query_id FROM deltas GROUP BY term) GROUP BY query_id) SELECT query_id, CAST(sum(coalesce(new, 0)) OVER (ORDER BY query_id) AS BIGINT) AS memory_size FROM steps LEFT JOIN new USING (query_id)",
    "crm_lookup": f"SELECT id, order_id, coalesce(customer, 'unknown') AS customer, coalesce(status, 'not found') AS status FROM (SELECT id, regexp_extract(message, 'ORD-\\d+', 0) AS order_id FROM {values([(1, 'where is ORD-001'), (2, 'refund ord-002 please ORD-002'), (3, 'ORD-999?'), (4, 'no id')], 'id, message')}) LEFT JOIN {values([('ORD-001', 'Alice Chen', 'active'), ('ORD-002', 'Bob Smith', 'cancelled'), ('ORD-003', 'Carol Wu', 'active')], 'order_id, customer, status')} USING (order_id)",
    "request_validation": "SELECT o_orderkey, error FROM (SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL THEN 'missing' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' WHEN o_totalprice < 1000 THEN 'price' END AS error FROM orders) WHERE error IS NOT NULL",
    "template_answer": f"WITH {POSTINGS}, q AS (SELECT query_id, {tokens('query')} AS terms FROM {CORPUS}), {hits('q')} SELECT query_id, string_agg(rank || '. ' || replace(text[1:80], chr(10), ' ') || ' [' || source || ']', chr(10) ORDER BY rank) AS answer FROM {ranked('hits', 3)} JOIN documents USING (doc_id) GROUP BY query_id",
    "badge_counts": f"SELECT CASE WHEN event_type = 'error' THEN 'CVE' WHEN k % 3 = 0 THEN 'SECURITY' WHEN k % 4 = 0 THEN 'BREAKING' ELSE 'OK' END AS badge, count(*) AS n FROM (SELECT event_type, {K} AS k FROM events) GROUP BY badge",
    "stream_memory": "SELECT ['alpha', 'bravo', 'carol'][user_id % 3 + 1] AS term, sum(CAST(value / 100 - 0.3 AS DOUBLE)) AS score, count(*) AS uses FROM events GROUP BY ALL",
    "embedding_topk": "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, u.vec_id, list_cosine_similarity(u.v, q.v) AS cosine FROM u JOIN u q ON q.vec_id % 50 = 0 AND u.vec_id <> q.vec_id) SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5",
}
