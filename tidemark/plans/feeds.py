"""Registered queries of scans and sinks, over small rows of the feeds' shapes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dictionaries as D
from tidemark.functions import text as T
from tidemark.operators import metrics as M
from tidemark.operators import retrieve as R
from tidemark.operators import vendor as V
from tidemark.plans import fixtures as X
from tidemark.plans import oracle as O
from tidemark.plans import queries as Q
from tidemark.sources import readers, sinks

_s = O._s
ASKED = [(1, "linux security patch update"), (2, "python release notes"), (3, "chrome crash"), (4, "nothing of the kind"), (5, "how do macos users feel")]
CVE_WORDS = [(1, "linux"), (2, "python"), (3, "zzqx")]
#: vendor, date wanted or null
WANTED = [(1, "linux", None), (2, "linux", "20260411"), (3, "python", "20260401"), (4, "chrome", None), (5, "nobody", None)]
TARGET = 8


def _asked(spark: SparkSession) -> DataFrame:
    return X.inline(spark, ASKED, "query_id long, query string").withColumn("terms", T.tokens(T.strip_marks(F.col("query"))))


def _posts(spark: SparkSession) -> DataFrame:
    return readers.json_rows(X.text(spark, X.posts_json()), f"struct<{readers._fields(readers.POST)}>")


def _releases(spark: SparkSession) -> DataFrame:
    return readers.release_rows(X.text(spark, X.releases_json()))


def releases_scan(spark, d):
    q = X.inline(spark, [(k, t) for k, t, _, _ in D.QUESTIONS], "query_id long, query string").withColumn("terms", T.expand_synonyms(T.tokens(F.col("query")), D.SYNONYMS))
    body = F.concat_ws(" ", F.array_join("versionSearchTags", " "), "versionProductName", "versionReleaseNotes")
    best = readers.best_hits(_releases(spark), q, body, [F.col("versionProductName"), F.col("versionNumber")], least=2)
    label = F.when(F.array_contains("classification.securityType", "SECURITY"), "Negative").otherwise("Neutral")
    return best.select("query_id", "rank", F.col("versionProductName").alias("name"), F.col("versionNumber").alias("number"), F.col("hits").cast("long").alias("hits"), label.alias("sentiment"))


def posts_scan(spark, d):
    best = readers.best_hits(_posts(spark), _asked(spark), F.concat_ws(" ", "title", "subreddit"), [F.col("title")])
    label = F.when(F.col("metadata.predicted.positiveScore") > 0.5, "Positive").otherwise("Neutral")
    return best.select("query_id", "rank", "title", label.alias("sentiment"), F.substring("created_utc", 1, 10).alias("day"), F.col("hits").cast("long").alias("hits"))


def cve_scan(spark, d):
    rows = X.inline(spark, X.CVES, "title string, url string, created string, detail string, score long")
    pairs = rows.join(R.small(X.inline(spark, CVE_WORDS, "query_id long, word string")), F.contains(F.lower(F.concat_ws(" ", "title", "detail")), F.col("word")))
    best = R.top(pairs, 3, F.col("created").desc(), F.col("title"))
    ident = F.when(F.contains("url", F.lit("CVE")), F.element_at(F.split("url", "/"), -1)).otherwise("")
    return best.select("query_id", "rank", "title", F.lit("Negative").alias("sentiment"), F.lit(0.5).alias("divergence"), F.substring("created", 1, 10).alias("day"), F.substring("detail", 1, 150).alias("detail"), ident.alias("cve_id"))


def news_scan(spark, d):
    items = readers.feed_items(X.text(spark, X.rss())).where("pos < 5")
    label = F.when(T.any_word(F.col("title"), D.NEWS_NEGATIVE), "Negative").otherwise("Neutral")
    pairs = items.join(R.small(_asked(spark).where("query_id <= 2")))
    return pairs.select("query_id", F.concat("query", F.lit(D.NEWS_SUFFIX)).alias("asked"), (F.col("pos") + 1).alias("rank"), "title", label.alias("sentiment"), F.col("summary").alias("publisher"), F.substring("published", 1, 16).alias("day"))


def vendor_rss_scan(spark, d):
    items = readers.feed_items(X.text(spark, X.rss()))
    pairs = items.join(R.small(_asked(spark))).withColumn("hits", T.overlap_substrings(F.col("terms"), F.lower("title")))
    found = pairs.where((F.col("hits") >= 1) | T.any_word(F.col("title"), D.RSS_PRODUCTS))
    label = F.when(T.any_word(F.col("title"), D.RSS_NEGATIVE), "Negative").otherwise("Positive")
    return R.top(found, 5, F.col("hits").desc(), F.col("pos")).select("query_id", "rank", "title", F.col("hits").cast("long").alias("hits"), label.alias("sentiment"))


def atom_scan(spark, d):
    best = readers.best_hits(readers.feed_items(X.text(spark, X.atom())), _asked(spark), F.concat_ws(" ", "title", "summary"), [F.col("pos")], limit=3)
    return best.select("query_id", "rank", "title", F.col("link").alias("url"), F.substring("published", 1, 10).alias("day"), F.col("hits").cast("long").alias("hits"))


def kev_scan(spark, d):
    body = F.concat_ws(" ", "vendorProject", "product", "vulnerabilityName", "shortDescription")
    best = readers.best_hits(readers.known_exploited_rows(X.text(spark, X.kev_json())), _asked(spark), body, [F.col("cveID")], least=2, limit=3)
    return best.select("query_id", "rank", F.col("cveID").alias("cve_id"), F.col("requiredAction").alias("action"), F.col("hits").cast("long").alias("hits"))


def code_host_scan(spark, d):
    """The latest release of the two newest repositories that the first telling word of a question finds."""
    word = F.get(F.filter(T.words(F.col("query")), lambda w: (F.length(w) > 3) & ~w.isin(D.CODE_HOST_STOP)), 0)
    q = _asked(spark).select("query_id", word.alias("word")).where("word is not null")
    rows = X.inline(spark, X.REPOSITORIES, "owner string, name string, updated string, release string, published string")
    found = rows.join(R.small(q), F.contains("name", F.col("word")))
    return R.top(found, 2, F.col("updated").desc(), F.col("name")).select("query_id", "rank", F.concat_ws("/", "owner", "name").alias("repository"), "release", "published")


def subreddit_search(spark, d):
    """Posts of the first two communities that a question is routed to."""
    route = None
    for found, to in D.SUBREDDITS:
        value = F.array(*map(F.lit, to))
        route = F.when(T.any_word(F.col("query"), found), value) if route is None else route.when(T.any_word(F.col("query"), found), value)
    route = route.otherwise(F.array(*map(F.lit, D.OTHER_SUBREDDITS)))
    subs = _asked(spark).select("query_id", "terms", F.explode(F.slice(route, 1, 2)).alias("subreddit"))
    found = _posts(spark).join(F.broadcast(subs), "subreddit").withColumn("hits", T.overlap_substrings(F.col("terms"), F.lower("title"))).where("hits > 0")
    label = F.when(T.any_word(F.col("title"), D.SEARCH_NEGATIVE), "Negative").otherwise("Positive")
    return R.top(found, 5, F.col("hits").desc(), F.col("title")).select("query_id", "rank", "subreddit", "title", label.alias("sentiment"))


def registry_load(spark, d):
    """The names of the registry, lower-cased, each once, with the list that has it first."""
    names = Q.table(spark, d, "part").select(F.lower("p_brand").alias("name"), F.lit("vendor").alias("kind")).unionByName(Q.table(spark, d, "nation").select(F.lower("n_name").alias("name"), F.lit("community").alias("kind")))
    return names.groupBy("name").agg(F.max("kind").alias("kind"))


def vendor_releases(spark, d):
    """Releases of a vendor: those up to a date, newest first; or without one, in canonical order."""
    rows = _releases(spark)
    w = X.inline(spark, WANTED, "query_id long, vendor string, target string")
    low = [F.lower("versionProductBrand"), F.lower("versionProductName")]
    pairs = rows.join(F.broadcast(w), "vendor").withColumn("name", F.col("versionProductName")).withColumn("number", F.col("versionNumber")).withColumn("day", F.col("versionReleaseDate"))
    dated = pairs.where(F.col("target").isNotNull() & (F.col("day") <= F.col("target")) & ((F.col("vendor") != "linux") | F.contains(low[0], F.lit("torvalds")) | F.contains(low[1], F.lit("torvalds"))))
    dated = R.top(dated, TARGET, F.col("day").desc(), F.col("name"), F.col("number"))
    known = F.lit(False)
    for v, names in D.CANONICAL.items():
        for n in names:
            known = known | ((F.col("vendor") == v) & (F.contains(low[0], F.lit(n)) | F.contains(low[1], F.lit(n))))
    known = known | (~F.col("vendor").isin(list(D.CANONICAL)) & (F.contains(low[0], F.col("vendor")) | F.contains(low[1], F.col("vendor"))))
    kind = F.when(known, 0).when(low[0] == F.col("vendor"), 1).when(F.col("isCve"), 3).otherwise(2)
    first = R.top(pairs.where("target is null").withColumn("kind", kind), TARGET, F.col("day").desc(), F.col("name"), F.col("number"), rank="before").drop("before")
    plain = R.top(first, TARGET, F.col("kind"), F.col("day").desc(), F.col("name"), F.col("number"))
    out = ["query_id", "rank", "name", "number", "day"]
    title = lambda df, made: df.select(*out, made.alias("title"))
    head = F.concat(F.col("versionProductBrand"), F.lit(" v"), "number")
    return title(dated, F.concat(head, F.lit(" (released "), F.substring("day", 1, 8), F.lit(") - "), F.substring("versionReleaseNotes", 1, 80))).unionByName(title(plain, F.concat(head, F.lit(" - "), F.substring("versionReleaseNotes", 1, 120))))


def vendor_posts(spark, d):
    """Posts of the first three communities of a question's vendor, by relevance, then by votes, with a good comment."""
    vendors = V.extract_vendor(_asked(spark).select("query_id", "query"), spark.createDataFrame(Q.CORPUS_VENDORS, "vendor string, stage int"))
    fan = V.fan_out(vendors).join(_asked(spark).select("query_id", "query"), "query_id").withColumn("terms", T.long_terms(F.col("query")))
    hits = T.overlap_substrings(F.col("terms"), F.lower(F.concat_ws(" ", "title", F.coalesce("author_description", F.lit("")))))
    hits = hits + F.when(F.contains(F.lower("title"), F.substring(F.lower("query"), 1, 25)), 10).otherwise(0)
    scored = _posts(spark).join(F.broadcast(fan), "subreddit").withColumn("hits", hits)
    best = R.top(scored, 8, F.col("hits").desc(), F.col("title"), rank="before")
    good = F.filter("comments", lambda c: (F.length(c["body"]) > 10) & ~c["body"].isin("[deleted]", "[removed]"))
    top = F.array_max(F.transform(good, lambda c: F.struct(c["score"].alias("score"), c["body"].alias("body"))))
    detail = F.when(top["score"] > 0, F.concat(F.lit("TOP: "), top["body"], F.lit(" | "), F.coalesce("author_description", F.lit("")))).otherwise(F.coalesce("author_description", F.lit("")))
    label = F.when(T.any_word(F.col("title"), D.POST_NEGATIVE), "Negative").otherwise("Positive")
    return R.top(best, 8, F.col("score").desc(), F.col("title")).select("query_id", "rank", "vendor", "subreddit", "title", label.alias("sentiment"), detail.alias("detail"))


def local_dataset(spark, d):
    rows = readers.json_rows(X.text(spark, X.analyzed_json().replace('"all_analyzed_posts"', '"data"')), readers.ANALYZED.split("array<", 1)[1][:-1])
    return rows.select("post_id", "title", "subreddit", F.initcap("title_sentiment.label").alias("sentiment"), F.col("score").cast("long").alias("score"), F.col("metrics.sentiment_divergence").alias("divergence"))


def paged_questions(spark, d):
    """Pages of questions, as a list or under ``data``, as one table."""
    import json

    pages = [json.dumps([{"title": t} for p, t in X.PAGES if p == 1]), json.dumps({"data": [{"title": t} for p, t in X.PAGES if p == 2]})]
    return readers.json_rows(X.text(spark, *pages), "struct<title: string>").groupBy("title").agg(F.count(F.lit(1)).alias("n"))


def question_set(spark, d):
    return readers.questions(X.inline(spark, X.QUESTION_RECORDS, readers.QUESTION), 10)


def server_filtered(spark, d):
    """The three feeds as a server filters them: by one word, a few rows, some columns."""
    has = lambda *c: F.contains(F.lower(F.concat_ws(" ", *c)), F.lit("linux"))
    cut = lambda df, kind, order: df.orderBy(*order).limit(3).select(F.lit(kind).alias("feed"), "title")
    releases = _releases(spark).where(has("versionProductName", "versionReleaseNotes")).select(F.concat_ws(" ", "versionProductName", "versionNumber").alias("title"), "versionReleaseDate")
    posts = _posts(spark).where(has("title", "subreddit")).select("title", "created_utc")
    cves = X.inline(spark, X.CVES, "title string, url string, created string, detail string, score long").where(has("title")).select("title", "created")
    return cut(releases, "releases", [F.col("versionReleaseDate").desc(), "title"]).unionByName(cut(posts, "posts", [F.col("created_utc").desc(), "title"])).unionByName(cut(cves, "cve", [F.col("created").desc(), "title"]))


def live_then_local(spark, d):
    """Documents of live sources for each question, of local ones only where there are none."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    docs, q = Q.table(spark, d, "documents"), Q.corpus_questions(spark)
    live = R.ranked(R.substring_hits(q, docs.where((number <= 2) & (F.col("lang") == "es")), least=2), 3).withColumn("origin", F.lit("live"))
    rest = q.join(live.select("query_id").distinct(), "query_id", "left_anti")
    return live.unionByName(R.ranked(R.substring_hits(rest, docs.where((number > 2) & (F.col("lang") == "es")), least=1), 3).withColumn("origin", F.lit("local")))


def _harvest(spark: SparkSession) -> DataFrame:
    posts = _posts(spark).select("title").where(F.contains("title", F.lit("?")))
    cves = X.inline(spark, X.CVES, "title string, url string, created string, detail string, score long").select("title")
    local = X.inline(spark, [(t,) for _, t in X.PAGES], "title string")
    return readers.harvest([posts, cves, local.where(F.contains("title", F.lit("?")))], 9)


def question_harvest(spark, d):
    return _harvest(spark).select("id", "title", "category")


def question_snapshot(spark, d):
    """The first five of the harvested questions: the quick run."""
    return _harvest(spark).where("id <= 5").select("id", "title")


def qrels_cache(spark, d):
    """Judgements kept under question:document, read as rows, of the latest of several runs."""
    import json

    kept = {"1:a": 2, "1:b": 0, "2:a:c": 1}
    runs = X.inline(spark, [("run_1", 10, "{}"), ("run_3", 30, json.dumps(kept)), ("run_2", 20, '{"9:z": 2}')], "run string, mtime long, value string")
    last = runs.agg(F.max_by(F.struct("run", "value"), "mtime").alias("m")).select("m.*")
    rows = last.select("run", F.explode(F.from_json("value", "map<string, int>")).alias("key", "grade"))
    return rows.select("run", F.substring_index("key", ":", 1).cast("long").alias("query_id"), F.expr("substring(key, instr(key, ':') + 1)").alias("doc_id"), "grade")


def api_smoke(spark, d):
    """How many rows of each feed have any of the words."""
    words = ["linux", "security", "patch", "update"]
    count = lambda df, kind, c: df.agg(F.count_if(T.any_word(c, words)).alias("n")).select(F.lit(kind).alias("feed"), "n")
    cves = X.inline(spark, X.CVES, "title string, url string, created string, detail string, score long")
    return count(_releases(spark), "releases", F.array_join("versionSearchTags", " ")).unionByName(count(_posts(spark), "posts", F.col("title"))).unionByName(count(cves, "cve", F.col("title")))


def run_lines(spark, d):
    """A line of JSON for each question and system."""
    rows = Q._rankings(spark, d).groupBy("query_id", "system").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    out = sinks.json_lines(rows.select(F.concat_ws("/", F.col("query_id").cast("string"), "system").alias("id"), "query_id", "system", "n", "first"), "id")
    return out


def qrels_upsert(spark, d):
    labels = Q.table(spark, d, "labels").select("doc_id", F.col("quality").alias("grade"))
    return sinks.upserted(labels, labels.where("doc_id % 3 = 0").withColumn("grade", F.col("grade") + 1), ["doc_id"])


def aggregate_csv(spark, d):
    rows = Q.table(spark, d, "events").groupBy("event_type").pivot("user_id", [1, 2, 10**9]).agg(F.avg("value"))
    return sinks.csv_lines(rows, "event_type", ["1", "2", str(10**9)])


def report_md(spark, d):
    """A line of mean and interval cells for each group, over all and by parity of the user."""
    e = Q.table(spark, d, "events").where(F.col("value").isNotNull())
    cell = lambda df, name: df.groupBy(F.col("event_type").alias("system"), name.alias("metric")).agg(*M.mean_ci(F.col("value")))
    cells = cell(e, F.lit("all")).unionByName(cell(e, F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")))
    return sinks.report(cells)


FEED_QUERIES = {
    f.__name__: f
    for f in (
        releases_scan, posts_scan, cve_scan, news_scan, vendor_rss_scan, atom_scan, kev_scan, code_host_scan, subreddit_search, registry_load, vendor_releases, vendor_posts, local_dataset, paged_questions,
        question_set, server_filtered, live_then_local, question_harvest, question_snapshot, qrels_cache, api_smoke, run_lines, qrels_upsert, aggregate_csv, report_md,
    )
}


# The SQL twins.


def _values(rows, names: str) -> str:
    row = lambda r: "(" + ", ".join("NULL" if v is None else _s(v) if isinstance(v, str) else str(v) for v in r) + ")"
    return f"(SELECT * FROM (VALUES {', '.join(map(row, rows))}) v({names}))"


def expanded(terms: str, synonyms: dict[str, list[str]]) -> str:
    extra = ", ".join(f"CASE WHEN list_has_any({terms}, {[base, *m]!r}) THEN {m!r} ELSE [] END" for base, m in synonyms.items())
    return f"list_distinct(flatten([{terms}, {extra}]))"


_REL = _values(X.RELEASES, "vendor, brand, name, number, notes, day, tags, secure, cve")
_POST = _values(X.POSTS, "post_id, title, subreddit, score, positive, created, num_comments, body, comment, votes, label, divergence")
_CVE = _values(X.CVES, "title, url, created, detail, score")
_RSS = _values([(k, *r) for k, r in enumerate(X.NEWS)], "pos, title, link, published, publisher")
_ATOM = _values([(k, *r) for k, r in enumerate(X.ATOM)], "pos, title, link, updated, summary")
_KEVS = _values(X.KEV, "vendor, product, name, description, cve_id, added, action")
_TERMS = O.tokens("translate(query, '?!', '')")
_Q = f"(SELECT query_id, query, {_TERMS} AS terms FROM {_values(ASKED, 'query_id, query')})"


def _hits(body: str) -> str:
    return f"len(list_filter(terms, lambda t: contains({body}, t)))"


def _top(source: str, columns: str, order: str, k: int) -> str:
    return f"SELECT query_id, rank, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


def _found(rows: str, body: str, least: int, questions: str = _Q) -> str:
    return f"(SELECT * FROM (SELECT *, {_hits(body)} AS hits FROM {rows} r CROSS JOIN {questions} q) WHERE hits >= {least})"


_SUBS = "CASE " + " ".join(f"WHEN {O.any_word('query', found)} THEN {to[:2]!r}" for found, to in D.SUBREDDITS) + f" ELSE {D.OTHER_SUBREDDITS[:2]!r} END"
_KNOWN = " OR ".join(f"(vendor = '{v}' AND (contains(lower(brand), {_s(n)}) OR contains(lower(name), {_s(n)})))" for v, names in D.CANONICAL.items() for n in names)
_KNOWN += f" OR (vendor NOT IN ({', '.join(map(_s, D.CANONICAL))}) AND (contains(lower(brand), vendor) OR contains(lower(name), vendor)))"
_FAN = "CASE vendor " + " ".join(f"WHEN {_s(v)} THEN {subs[:3]!r}" for v, subs in D.VENDOR_COMMUNITIES.items()) + " ELSE [vendor] END"
_VENDOR = O.vendor_sql(_values(ASKED, "query_id, query"))
_LONG = f"list_transform(list_filter({O.words('query')}, lambda t: length(t) > 3), lambda t: regexp_replace(t, '^[?!.,]+|[?!.,]+$', '', 'g'))"
_HARVEST = f"""(SELECT row_number() OVER (ORDER BY priority, title) AS id, title, {O.first_match('title', D.CATEGORIES, 'general')} AS category FROM (SELECT title, min(priority) AS priority FROM (
  SELECT title, 0 AS priority FROM {_POST} WHERE contains(title, '?') UNION ALL SELECT title, 1 FROM {_CVE} UNION ALL SELECT title, 2 FROM {_values(X.PAGES, 'page, title')} WHERE contains(title, '?')) GROUP BY title ORDER BY priority, title LIMIT 9))"""
_ES = f"(SELECT doc_id, lower(text) AS low, {O.NUMBER} AS number FROM documents WHERE lang = 'es')"
_CORPUS = f"(SELECT query_id, {O.tokens('query')} AS terms FROM {O.CORPUS})"
_CELL = "printf('%.3f ± %.3f', mean, ci95)"

FEED_SQL = {
    "releases_scan": _top(_found(f"(SELECT *, lower(tags || ' ' || name || ' ' || notes) AS low FROM {_REL})", "low", 2, f"(SELECT query_id, {expanded(O.tokens('query'), D.SYNONYMS)} AS terms FROM {_values([(k, t) for k, t, _, _ in D.QUESTIONS], 'query_id, query')})"), "name, number, hits, CASE secure WHEN 1 THEN 'Negative' ELSE 'Neutral' END AS sentiment", "hits DESC, name, number", 5),
    "posts_scan": _top(_found(f"(SELECT *, lower(title || ' ' || subreddit) AS low FROM {_POST})", "low", 1), "title, CASE WHEN positive > 0.5 THEN 'Positive' ELSE 'Neutral' END AS sentiment, created[1:10] AS day, hits", "hits DESC, title", 5),
    "cve_scan": _top(f"(SELECT * FROM {_CVE} c JOIN {_values(CVE_WORDS, 'query_id, word')} w ON contains(lower(title || ' ' || detail), word))", "title, 'Negative' AS sentiment, 0.5::DOUBLE AS divergence, created[1:10] AS day, detail[1:150] AS detail, CASE WHEN contains(url, 'CVE') THEN string_split(url, '/')[-1] ELSE '' END AS cve_id", "created DESC, title", 3),
    "news_scan": f"SELECT query_id, query || {_s(D.NEWS_SUFFIX)} AS asked, pos + 1 AS rank, title, CASE WHEN {O.any_word('title', D.NEWS_NEGATIVE)} THEN 'Negative' ELSE 'Neutral' END AS sentiment, publisher, published[1:16] AS day FROM {_RSS} r CROSS JOIN {_Q} q WHERE pos < 5 AND query_id <= 2",
    "vendor_rss_scan": _top(f"(SELECT * FROM (SELECT *, {_hits('lower(title)')} AS hits FROM {_RSS} r CROSS JOIN {_Q} q) WHERE hits >= 1 OR {O.any_word('title', D.RSS_PRODUCTS)})", f"title, hits, CASE WHEN {O.any_word('title', D.RSS_NEGATIVE)} THEN 'Negative' ELSE 'Positive' END AS sentiment", "hits DESC, pos", 5),
    "atom_scan": _top(_found(_ATOM, "lower(title || ' ' || summary)", 1), "title, link AS url, updated[1:10] AS day, hits", "hits DESC, pos", 3),
    "kev_scan": _top(_found(_KEVS, "lower(vendor || ' ' || product || ' ' || name || ' ' || description)", 2), "cve_id, action, hits", "hits DESC, cve_id", 3),
    "code_host_scan": _top(f"(SELECT * FROM {_values(X.REPOSITORIES, 'owner, name, updated, release, published')} r JOIN (SELECT query_id, list_filter({O.words('query')}, lambda w: length(w) > 3 AND NOT list_contains({D.CODE_HOST_STOP!r}, w))[1] AS word FROM {_Q}) q ON contains(name, word))", "owner || '/' || name AS repository, release, published", "updated DESC, name", 2),
    "subreddit_search": _top(f"(SELECT * FROM (SELECT p.*, q.query_id, {_hits('lower(title)')} AS hits FROM {_POST} p JOIN (SELECT query_id, terms, unnest({_SUBS}) AS subreddit FROM {_Q}) q USING (subreddit)) WHERE hits > 0)", f"subreddit, title, CASE WHEN {O.any_word('title', D.SEARCH_NEGATIVE)} THEN 'Negative' ELSE 'Positive' END AS sentiment", "hits DESC, title", 5),
    "registry_load": "SELECT name, max(kind) AS kind FROM (SELECT lower(p_brand) AS name, 'vendor' AS kind FROM part UNION ALL SELECT lower(n_name), 'community' FROM nation) GROUP BY name",
    "vendor_releases": f"""WITH p AS (SELECT r.*, w.query_id, w.target FROM {_REL} r JOIN {_values(WANTED, 'query_id, vendor, target')} w USING (vendor)),
dated AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY day DESC, name, number) AS rank FROM p WHERE target IS NOT NULL AND day <= target AND (vendor <> 'linux' OR contains(lower(brand), 'torvalds') OR contains(lower(name), 'torvalds'))),
firsts AS (SELECT *, CASE WHEN {_KNOWN} THEN 0 WHEN lower(brand) = vendor THEN 1 WHEN cve = 1 THEN 3 ELSE 2 END AS kind, row_number() OVER (PARTITION BY query_id ORDER BY day DESC, name, number) AS before FROM p WHERE target IS NULL),
plain AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, day DESC, name, number) AS rank FROM firsts WHERE before <= {TARGET})
SELECT query_id, rank, name, number, day, brand || ' v' || number || ' (released ' || day[1:8] || ') - ' || notes[1:80] AS title FROM dated WHERE rank <= {TARGET} UNION ALL SELECT query_id, rank, name, number, day, brand || ' v' || number || ' - ' || notes[1:120] FROM plain""",
    "vendor_posts": f"""WITH v AS ({_VENDOR}), fan AS (SELECT query_id, vendor, unnest(({_FAN})[1:3]) AS subreddit FROM v),
scored AS (SELECT p.*, f.query_id, f.vendor, len(list_filter({_LONG}, lambda t: contains(lower(title || ' ' || body), t))) + CASE WHEN contains(lower(title), lower(query)[1:25]) THEN 10 ELSE 0 END AS hits FROM {_POST} p JOIN fan f USING (subreddit) JOIN {_Q} q ON q.query_id = f.query_id),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, title) <= 8)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title) AS rank, vendor, subreddit, title, CASE WHEN {O.any_word('title', D.POST_NEGATIVE)} THEN 'Negative' ELSE 'Positive' END AS sentiment, CASE WHEN length(comment) > 10 AND votes > 0 THEN 'TOP: ' || comment || ' | ' || body ELSE body END AS detail FROM best""",
    "local_dataset": f"SELECT post_id, title, subreddit, label AS sentiment, score::BIGINT AS score, divergence::DOUBLE AS divergence FROM {_POST}",
    "paged_questions": f"SELECT title, count(*) AS n FROM {_values(X.PAGES, 'page, title')} GROUP BY title",
    "question_set": f"SELECT * FROM (SELECT id, coalesce(nullif(trim(query), ''), nullif(trim(question), ''), nullif(trim(title), '')) AS query, category, coalesce(nullif(trim(ground_truth), ''), nullif(trim(gt), '')) AS ground_truth FROM {_values(X.QUESTION_RECORDS, 'id, query, question, title, category, ground_truth, gt')}) WHERE query IS NOT NULL",
    "server_filtered": f"(SELECT 'releases' AS feed, name || ' ' || number AS title FROM {_REL} WHERE contains(lower(name || ' ' || notes), 'linux') ORDER BY day DESC, title LIMIT 3) UNION ALL (SELECT 'posts', title FROM {_POST} WHERE contains(lower(title || ' ' || subreddit), 'linux') ORDER BY created DESC, title LIMIT 3) UNION ALL (SELECT 'cve', title FROM {_CVE} WHERE contains(lower(title), 'linux') ORDER BY created DESC, title LIMIT 3)",
    "live_then_local": f"WITH q AS {_CORPUS}, h AS (SELECT query_id, doc_id, number, {_hits('low')} AS hits FROM {_ES} d CROSS JOIN q), a AS (SELECT * FROM h WHERE number <= 2 AND hits >= 2), live AS {O.ranked('a', 3)}, b AS (SELECT * FROM h WHERE number > 2 AND hits >= 1 AND query_id NOT IN (SELECT query_id FROM live)) SELECT *, 'live' AS origin FROM live UNION ALL SELECT *, 'local' FROM {O.ranked('b', 3)}",
    "question_harvest": f"SELECT id, title, category FROM {_HARVEST}",
    "question_snapshot": f"SELECT id, title FROM {_HARVEST} WHERE id <= 5",
    "qrels_cache": f"SELECT * FROM {_values([('run_3', 1, 'a', 2), ('run_3', 1, 'b', 0), ('run_3', 2, 'a:c', 1)], 'run, query_id, doc_id, grade')}",
    "api_smoke": " UNION ALL ".join(f"SELECT '{kind}' AS feed, count(*) FILTER ({O.any_word(c, ['linux', 'security', 'patch', 'update'])}) AS n FROM {rows}" for kind, c, rows in (("releases", "tags", _REL), ("posts", "title", _POST), ("cve", "title", _CVE))),
    "run_lines": f"""WITH {O.RANKINGS}, g AS (SELECT query_id, system, count(*) AS n, min(doc_id) AS first FROM rankings GROUP BY ALL) SELECT query_id || '/' || system AS id, '{{"id":"' || query_id || '/' || system || '","query_id":' || query_id || ',"system":"' || system || '","n":' || n || ',"first":' || first || '}}' AS line FROM g""",
    "qrels_upsert": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality + 1 ELSE quality END AS grade FROM labels",
    "aggregate_csv": "SELECT event_type, event_type || ',' || coalesce(printf('%.3f', a), '') || ',' || coalesce(printf('%.3f', b), '') || ',' AS line FROM (SELECT event_type, avg(value) FILTER (user_id = 1) AS a, avg(value) FILTER (user_id = 2) AS b FROM events GROUP BY event_type)",
    "report_md": f"WITH c AS (SELECT event_type AS system, metric, avg(value) AS mean, CASE WHEN count(value) < 2 THEN 0.0 ELSE 1.96 * stddev_samp(value) / sqrt(count(value)) END AS ci95 FROM (SELECT event_type, value, unnest(['all', CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS metric FROM events WHERE value IS NOT NULL) GROUP BY ALL) SELECT system, '| ' || system || ' | ' || string_agg({_CELL}, ' | ' ORDER BY metric) || ' |' AS line FROM c GROUP BY system",
}
