"""Registered queries of answers, judging, memory, requests and comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dictionaries as D
from tidemark.functions import text as T
from tidemark.operators import retrieve as R
from tidemark.operators import score as S
from tidemark.operators import vendor as V
from tidemark.plans import feeds
from tidemark.plans import fixtures as X
from tidemark.plans import oracle as O
from tidemark.plans import queries as Q
from tidemark.sources import sinks

_s = O._s
#: query_id, query, community that it comes from
HINTED = [(1, "it stopped again", "homelab"), (2, "chrome is slow", "linux"), (3, "no idea", "gardening"), (4, "which nodes", "ComfyUI"), (5, "nothing", None)]
#: query_id, query
VENDOR_ASKED = [(1, "linux kernel panic"), (2, "home assistant stopped"), (3, "chrome crash"), (4, "python release"), (5, "zzqx")]
#: query_id, position, source, title, detail, comment, votes, url
ANSWER_DOCS = [
    (1, 1, "cve", "CVE-2026-1001 in linux", "An exploit of the scheduler", "", 0, "https://nvd.example.org/CVE-2026-1001"), (1, 2, "vendor_releases", "linux kernel 6.9.1", "security patch", "", 0, "https://r.example.com/6.9.1"),
    (1, 3, "vendor_reddit", "Linux kernel update broke my desktop", "no desktop", "wait for the next kernel", 31, "https://p.example.com/p1"), (1, 4, "local", "old post", "", "old comment", 40, ""),
    (2, 1, "reddit_live", "Is the new python release stable?", "asking", "works", 9, "https://p.example.com/p2"), (2, 2, "releases", "python 3.13.2", "bug fix release", "", 0, "https://r.example.com/py"),
    (3, 1, "elsewhere", "a rumour", "", "", 0, ""), (4, 1, "vendor_reddit", "Chrome crash fix", "fixed", "confirmed fixed", 14, "u"), (4, 2, "reddit_live", "another crash", "x", "me too", 14, "v"), (4, 3, "cisa_kev", "Chrome Type Confusion", "a vulnerability", "", 0, "w"),
]
ANSWER_QUESTIONS = [(1, "linux kernel security"), (2, "python release"), (3, "rumour"), (4, "how is chrome"), (5, "nobody")]
MEMORY_ROWS = [(1, "fix the update", "fix the update changelog patch", 0.5), (2, "kernel", "kernel panic changelog", 0.05), (3, "browser crash", "browser crash patch hotfix", 0.4), (4, "release", "release notes changelog", 0.2), (5, "x", "x hotfix notes", 0.1)]
DATASETS = [("two", ["a", "b"]), ("turned", ["b", "a"]), ("none", [])]


def _docs(spark: SparkSession) -> DataFrame:
    return X.inline(spark, ANSWER_DOCS, "query_id long, pos int, source string, title string, detail string, comment string, votes long, url string")


def vendor_hint(spark, d):
    q = X.inline(spark, HINTED, "query_id long, query string, hint string")
    return V.with_hint(q, V.extract_vendor(q, spark.createDataFrame(Q.CORPUS_VENDORS, "vendor string, stage int")))


def vendor_fanout(spark, d):
    q = X.inline(spark, VENDOR_ASKED, "query_id long, query string")
    return V.fan_out(V.extract_vendor(q, spark.createDataFrame(Q.CORPUS_VENDORS, "vendor string, stage int")))


def fuzzy_candidates(spark, d):
    """Words of the questions that may name a vendor by likeness."""
    return V.fuzzy_words(Q.questions(spark))


def post_by_id(spark, d):
    """Documents by id; an id that no document has gives a message."""
    wanted = X.inline(spark, [(1,), (7,), (10**12,)], "doc_id long")
    rows = wanted.join(Q.table(spark, d, "documents").select("doc_id", "source"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("source", F.lit("not found")).alias("found"))


def most_negative(spark, d):
    rows = X.inline(spark, X.POSTS, "post_id string, title string, subreddit string, score long, positive double, created string, comments long, body string, comment string, votes long, label string, divergence double")
    best = rows.where("label = 'Negative'").orderBy(F.col("divergence").desc(), "post_id").limit(10)
    return best.select("post_id", "divergence", F.when(F.col("divergence") > 0.3, "community disagrees").otherwise("community agrees").alias("meaning"))


def best_comment(spark, d):
    """The comment with the most votes over ten among a question's documents that are not official."""
    rows = _docs(spark).where(~F.col("source").isin(D.TIER1) & (F.col("votes") > 10) & (F.col("comment") != ""))
    return R.top(rows, 1, F.col("votes").desc(), F.col("pos")).select("query_id", "comment", "votes", "url")


def vendor_first_context(spark, d):
    """Up to eight documents, a vendor's first; notices of flaws only where the question is about security."""
    first = F.when(F.col("source").isin("vendor_releases", "vendor_reddit"), 0).otherwise(1)
    kind = F.when(F.col("source").isin("vendor_reddit", "reddit_live"), "COMMUNITY POST").otherwise("RELEASE NOTE")
    ident = F.when(F.contains("url", F.lit("CVE")), F.element_at(F.split("url", "/"), -1)).otherwise("")
    entry = F.concat(F.lit("["), kind, F.lit("] "), F.substring("title", 1, 120), F.when(F.col("detail") != "", F.concat(F.lit(" | "), F.substring("detail", 1, 350))).otherwise(""), F.when(ident != "", F.concat(F.lit(" | "), ident)).otherwise(""))
    best = R.top(_docs(spark).withColumn("entry", entry), 8, first, F.col("pos")).join(X.inline(spark, ANSWER_QUESTIONS, "query_id long, query string"), "query_id")
    notice = F.contains("entry", F.lit("CISA")) | F.contains("entry", F.lit("CVE-")) | T.any_word(F.col("entry"), D.DROPPED_CONTEXT)
    return best.where(T.any_word(F.col("query"), D.SECURITY_WORDS) | ~notice).select("query_id", "rank", "entry")


def readings_page(spark, d):
    """The first readings of each room with the room's total; the page number is echoed."""
    e = Q.table(spark, d, "events").select(F.concat(F.lit("room-"), (F.col("user_id") % 4).cast("string")).alias("query_id"), "event_id", "ts")
    total = e.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return R.top(e, 25, F.col("event_id")).join(F.broadcast(total), "query_id").select(F.col("query_id").alias("room"), "event_id", "rank", "total", F.lit(1).alias("page"))


def room_day(spark, d):
    """Light of a room and day: seconds on and off, hours and share of the day."""
    e = Q.table(spark, d, "events").where("event_type = 'view'")
    by = e.groupBy(F.concat(F.lit("room-"), (F.col("user_id") % 4).cast("string")).alias("room"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.count(F.lit(1)) * 60).alias("on_seconds"))
    on = F.least("on_seconds", F.lit(86400))
    return by.select("room", "day", on.alias("on_seconds"), (86400 - on).alias("off_seconds"), (on / 3600).alias("hours_on"), (on / 86400 * 100).alias("pct_on"))


def first_doc_overlap(spark, d):
    """Share of a question's words in the first sentence of its best document; 0 without one."""
    q, docs = Q.benchmark(spark, d).unionByName(Q.corpus_questions(spark).withColumn("query_id", -F.col("query_id"))), Q.table(spark, d, "documents")
    best = R.ranked(R.token_hits(q, docs), 1).join(docs.select("doc_id", F.substring_index("text", ".", 1).alias("title")), "doc_id").select("query_id", "title")
    rows = q.join(best, "query_id", "left")
    quality = F.when(F.col("title").isNull(), 0.0).otherwise(F.least(T.overlap_tokens(F.col("terms"), T.tokens(F.col("title"))) / F.greatest(F.size("terms"), F.lit(1)), F.lit(1.0)))
    return rows.select("query_id", quality.alias("quality"), (quality >= 0.15).alias("positive"))


def signal_bucket_v1(spark, d):
    q = F.col("value") / 100
    bucket = F.when(q >= 0.6, "excellent").when(q >= 0.4, "positive").when(q >= 0.2, "acceptable").otherwise("negative")
    return Q.table(spark, d, "events").select("event_id", bucket.alias("signal"))


def tier_join(spark, d):
    """Tiers by a join with the table of sources; a source that it lacks is unverified."""
    rows = [(s, 1) for s in D.TIER1] + [(s, 2) for s in D.TIER2]
    dim = X.inline(spark, rows, "source string, tier int")
    docs = _docs(spark).join(F.broadcast(dim), "source", "left")
    return docs.select("query_id", "pos", "source", T.tier_name(F.coalesce("tier", F.lit(3))).alias("label"))


def verdict_counts(spark, d):
    rows = X.inline(spark, [(v,) for v in X.VERDICTS], "verdict string")
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).select("verdict", "n", (F.col("n") / len(X.VERDICTS)).alias("share"))


def rewrite_dated(spark, d):
    today = [("today", f"released {Q.RUN_DATE:%Y-%m-%d}")]
    return Q.questions(spark).select("query_id", T.rewrite(F.col("query"), [*D.DATED_EXPANSIONS, *today]).alias("rewritten"), F.concat("query", F.lit(D.RETRY_SUFFIX)).alias("retried"))


def _memory(spark: SparkSession) -> DataFrame:
    rows = X.inline(spark, MEMORY_ROWS, "seq long, query string, rewritten string, quality double")
    return S.class_deltas(rows, "seq", F.col("query"), F.col("rewritten"), F.col("quality"))


def class_memory(spark, d):
    """Score of each term, of which a failed question has taken twice."""
    return _memory(spark).groupBy("term").agg(F.sum("delta").alias("score"), F.count(F.lit(1)).alias("uses"))


def memory_suffix(spark, d):
    """Each question with the best terms of the memory that it lacks."""
    best = _memory(spark).groupBy("term").agg(F.round(F.sum("delta"), 9).alias("score")).orderBy(F.col("score").desc(), "term").limit(3)
    terms = best.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))), lambda x: x["term"]).alias("best"))  # three terms
    asked = Q.questions(spark).join(F.broadcast(terms))
    return asked.select("query_id", F.trim(F.concat("query", F.lit(" "), S.suggested(F.col("query"), F.col("best")))).alias("query"))


def memory_status(spark, d):
    rows = X.inline(spark, MEMORY_ROWS, "seq long, query string, rewritten string, quality double")
    good = F.col("quality") >= 0.15
    return rows.agg((F.count_if(good) + 2 * F.count_if(~good)).alias("queries"), (2 * F.count_if(~good)).alias("improvements"), F.count_if(good).alias("successes"), (2 * F.count_if(~good)).alias("failures"), F.max_by("rewritten", "quality").alias("best"))


def agent_retry(spark, d):
    """The attempt that ends each agent's retries: the first of score 6 and more, the third at the latest."""
    rows = X.inline(spark, X.AGENT_RUNS, "query_id long, attempt int, agent string, score double, output string").where("attempt <= 3")
    window = Window.partitionBy("query_id", "agent").orderBy((F.col("score") >= 6).desc(), F.when(F.col("score") >= 6, F.col("attempt")).otherwise(-F.col("attempt")))
    last = rows.withColumn("r", F.row_number().over(window)).where("r = 1")
    return last.select("query_id", "agent", (F.col("attempt") - 1).alias("retries"), "score", (F.col("score") >= 6).alias("passed"))


def merge_outputs(spark, d):
    """One agent's output as it is; several as labelled parts of 400 characters."""
    rows = X.inline(spark, X.AGENT_RUNS, "query_id long, attempt int, agent string, score double, output string").where("attempt = 1")
    part = F.concat(F.lit("["), "agent", F.lit("]:\n"), F.substring("output", 1, 400))
    by = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("output").alias("only"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("agent", part.alias("part")))), lambda x: x["part"]), "\n\n---\n\n").alias("merged"))  # a few agents a task
    return by.select("query_id", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("merged")).alias("answer"))


def judge_labels(spark, d):
    """Relevance of a judge's replies: rounded half to even, from 0 to 2; 0 where there is none."""
    rows = X.inline(spark, X.REPLIES, "id long, reply string, has_gt int").where("id <= 7")
    got = T.first_json(F.col("reply"), "relevance string")["relevance"].try_cast("double")
    return rows.select("id", F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(F.bround(got, 0), F.lit(0.0)).cast("int"))).alias("grade"))


def answer_scores(spark, d):
    """Three axes of a judge's replies, each from 0 to 1; no correctness without a reference answer."""
    rows = X.inline(spark, X.REPLIES, "id long, reply string, has_gt int").where("id > 7")
    got = T.first_json(F.col("reply"), "faithfulness string, answer_relevance string, correctness string")
    right = F.when((F.col("has_gt") == 1) & got["correctness"].isNotNull(), T.clamp(got["correctness"]))
    return rows.select("id", T.clamp(got["faithfulness"]).alias("faithfulness"), T.clamp(got["answer_relevance"]).alias("answer_relevance"), right.alias("correctness"))


def paired_significance(spark, d):
    """t statistic and effect size of the difference between two systems over the same questions."""
    rows = Q.ir_metrics(spark, d).groupBy("query_id").pivot("system", ["short", "tokens"]).agg(F.max("precision_5")).where("short is not null and tokens is not null")
    diff = F.col("tokens") - F.col("short")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sd"))
    return out.select("n", "mean", (F.col("mean") / (F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt("n"))).alias("t"), (F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))).alias("d"))


def sentiment_split(spark, d):
    """Per community: negative and positive posts, and the title of the first of each as bullet lines."""
    rows = X.inline(spark, X.POSTS, "post_id string, title string, subreddit string, score long, positive double, created string, comments long, body string, comment string, votes long, label string, divergence double")
    line = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == x, F.col("title")))), lambda t: F.concat(F.lit("- "), F.substring(t, 1, 55))), "\n")  # noqa: E731  a few posts
    return rows.groupBy((F.col("score") >= 10).alias("popular")).agg(F.count_if(F.col("label") == "Negative").alias("negative"), F.count_if(F.col("label") == "Positive").alias("positive"), F.countDistinct("subreddit").alias("communities"), line("Negative").alias("issues"), line("Positive").alias("updates"))


def final_answer(spark, d):
    """Security releases, else all; advisories; and the number of posts, as lines of one text for each question."""
    q = feeds._asked(spark)
    releases = feeds._releases(spark)
    body = F.concat_ws(" ", F.array_join("versionSearchTags", " "), "versionProductName", "versionReleaseNotes")
    pairs = releases.join(F.broadcast(q.select("query_id", "terms"))).where(T.overlap_substrings(F.col("terms"), F.lower(body)) >= 1).withColumn("secure", F.array_contains("classification.securityType", "SECURITY"))
    label = F.concat(F.col("versionProductName"), F.lit(" v"), "versionNumber", F.lit(" ("), "versionReleaseDate", F.lit(")"))
    listed = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("secure")).alias("n_secure"), F.array_sort(F.collect_list(F.when(F.col("secure"), label))).alias("s"), F.array_sort(F.collect_list(label)).alias("a"))  # the feed's few rows
    cves = X.inline(spark, X.CVES, "title string, url string, created string, detail string, score long").join(F.broadcast(q.select("query_id", "terms"))).where(T.overlap_substrings(F.col("terms"), F.lower("title")) >= 1)
    advice = cves.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_cve"), F.array_sort(F.collect_list(F.substring("title", 1, 80))).alias("c"))
    posts = feeds._posts(spark).join(F.broadcast(q.select("query_id", "terms"))).where(T.overlap_substrings(F.col("terms"), F.lower("title")) >= 1).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_posts"))
    rows = q.join(listed, "query_id", "left").join(advice, "query_id", "left").join(posts, "query_id", "left")
    some = F.when(F.col("n_secure") > 0, F.concat(F.col("n_secure").cast("string"), F.lit(" security release(s): "), F.array_join(F.slice("s", 1, 3), "; "))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" release(s): "), F.array_join(F.slice("a", 1, 3), "; ")))
    parts = F.array_compact(F.array(some, F.concat(F.col("n_cve").cast("string"), F.lit(" advisories: "), F.array_join(F.slice("c", 1, 2), "; ")), F.concat(F.col("n_posts").cast("string"), F.lit(" community post(s)"))))
    return rows.select("query_id", F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("no results").alias("answer"))


def tiered_answer(spark, d):
    """The answer's sections in order: official sources, best comment, community sources, others."""
    tier = T.tier(F.col("source"), D.TIER1, D.TIER2)
    rows = _docs(spark).withColumn("tier", tier)
    line = F.concat(F.lit("- ["), "source", F.lit("] "), F.substring("title", 1, 90), F.when((F.col("tier") == 1) & (F.col("detail") != ""), F.concat(F.lit(": "), F.substring("detail", 1, 100))).otherwise(""))
    numbered = rows.withColumn("line", line).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "tier").orderBy("pos"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "tier")))
    most = F.when(F.col("tier") == 3, 2).otherwise(4)
    kept = numbered.where(F.col("r") <= most).groupBy("query_id", "tier", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("lines"))  # four lines
    head = F.when(F.col("tier") == 1, "VERIFIED SOURCES (").when(F.col("tier") == 2, "COMMUNITY SOURCES (").otherwise("OTHER SOURCES (")
    sections = kept.select("query_id", (F.col("tier") * 2).alias("ord"), F.concat(head, F.col("n").cast("string"), F.lit(")\n"), "lines").alias("text"))
    comment = best_comment(spark, d).select("query_id", F.lit(3).alias("ord"), F.concat(F.lit("TOP COMMUNITY ANSWER ("), F.col("votes").cast("string"), F.lit(")\n"), F.substring("comment", 1, 200)).alias("text"))
    every = sections.unionByName(comment).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("answer"))  # four sections
    q = X.inline(spark, ANSWER_QUESTIONS, "query_id long, query string").join(every, "query_id", "left")
    return q.select("query_id", F.concat(F.lit("Query: "), "query", F.lit("\n"), F.coalesce("answer", F.lit("NO RESULTS FOUND"))).alias("answer"))


def agent_scores(spark, d):
    rows = X.inline(spark, X.AGENT_RUNS, "query_id long, attempt int, agent string, score double, output string")
    return rows.groupBy("query_id").agg(F.avg("score").alias("mean"), F.countDistinct("agent").alias("agents"))


def latency_by_system(spark, d):
    rows = X.inline(spark, X.LATENCIES, "system string, query_id long, seconds double")
    return rows.groupBy("system").agg(F.avg("seconds").alias("mean"), F.count("seconds").alias("n"))


def request_rules(spark, d):
    """The first rule that each request breaks, or ok."""
    rows = X.inline(spark, X.REQUESTS, "id long, kind string, payload string")
    get = lambda name: F.get_json_object("payload", f"$.{name}")

    def missing(*names):
        out = F.lit(None).cast("string")
        for n in reversed(names):
            out = F.when(get(n).isNull(), F.lit(f"missing {n}")).otherwise(out)
        return out

    sensor = F.coalesce(missing("room_id", "light_state", "lux", "timestamp"), F.when(~get("light_state").isin(D.LIGHT_STATES), "light_state"))
    room = F.coalesce(F.when(get("room").isNull() | ~get("room").isin(D.ROOMS), "room"), missing("date", "onSeconds"))
    user = F.coalesce(missing("email", "password"), F.when(~F.contains(get("email"), F.lit("@")), "email"), F.when(F.length(get("password")) < D.LEAST_PASSWORD, "password"))
    error = F.when(F.col("kind") == "sensor", sensor).when(F.col("kind") == "room", room).otherwise(user)
    return rows.select("id", F.coalesce(error, F.lit("ok")).alias("result"))


def dataset_hashes(spark, d):
    return X.inline(spark, [(n, sinks.dataset_hash(q)) for n, q in DATASETS], "name string, hash string")


def provider_specs(spark, d):
    """Backend and model of a specification; without a known backend all of it is a model of the first."""
    rows = X.inline(spark, [(s,) for s in X.SPECS], "spec string")
    backend = F.substring_index("spec", ":", 1)
    known = F.contains("spec", F.lit(":")) & backend.isin(X.BACKENDS)
    return rows.select("spec", F.when(known, backend).otherwise(X.BACKENDS[0]).alias("backend"), F.when(known, F.expr("substring(spec, instr(spec, ':') + 1)")).otherwise(F.col("spec")).alias("model"))


def positional_join(spark, d):
    """Rows of two lists by their place, as long as the shorter one."""
    e = Q.table(spark, d, "events")
    side = lambda kind, name: e.where(F.col("event_type") == kind).select(F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"), "user_id", F.col("value").alias(name))
    return side("view", "baseline").join(side("click", "treated"), ["user_id", "n"]).select("user_id", "n", (F.col("treated") - F.col("baseline")).alias("gain"))


def normalised_documents(spark, d):
    """id, text, source of documents of different shapes: the detail, else the comment, else nothing."""
    text = F.coalesce(F.nullif(F.col("detail"), F.lit("")), F.nullif(F.col("comment"), F.lit("")), F.lit(""))
    return _docs(spark).select("query_id", "pos", T.short_id(F.col("url"), F.col("title"), F.col("source")).alias("doc_id"), text.alias("text"))


ANSWER_QUERIES = {
    f.__name__: f
    for f in (
        vendor_hint, vendor_fanout, fuzzy_candidates, post_by_id, most_negative, best_comment, vendor_first_context, readings_page, room_day, first_doc_overlap, signal_bucket_v1, tier_join, verdict_counts,
        rewrite_dated, class_memory, memory_suffix, memory_status, agent_retry, merge_outputs, judge_labels, answer_scores, paired_significance, sentiment_split, final_answer, tiered_answer, agent_scores,
        latency_by_system, request_rules, dataset_hashes, provider_specs, positional_join, normalised_documents,
    )
}


# The SQL twins.
_values, _hits = feeds._values, feeds._hits
_DOCS = _values(ANSWER_DOCS, "query_id, pos, source, title, detail, comment, votes, url")
_HINTED = _values(HINTED, "query_id, query, hint")
_MEM = _values(MEMORY_ROWS, "seq, query, rewritten, quality")
_DELTAS = f"(SELECT seq, term, unnest(CASE WHEN quality >= 0.15 THEN [quality::DOUBLE] ELSE [-0.1::DOUBLE, -0.1::DOUBLE] END) AS delta FROM (SELECT seq, quality, unnest(list_filter({O.tokens('rewritten')}, lambda t: NOT list_contains({O.tokens('query')}, t))) AS term FROM {_MEM}))"
_RUNS = _values(X.AGENT_RUNS, "query_id, attempt, agent, score, output")
_REPLY = _values(X.REPLIES, "id, reply, has_gt")
_IN1, _IN2 = (", ".join(map(_s, t)) for t in (D.TIER1, D.TIER2))
_TIER = f"CASE WHEN source IN ({_IN1}) THEN 1 WHEN source IN ({_IN2}) THEN 2 ELSE 3 END"
_NAMES = "CASE tier WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'COMMUNITY' ELSE 'UNVERIFIED' END"
_COMMENT = f"(SELECT query_id, comment, votes, url FROM {_DOCS} WHERE source NOT IN ({_IN1}) AND votes > 10 AND comment <> '' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, pos) = 1)"
_CVE_ID = "CASE WHEN contains(url, 'CVE') THEN string_split(url, '/')[-1] ELSE '' END"
_JSON = "regexp_extract(reply, '(?s)\\{.*\\}', 0)"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(try_cast({x} AS DOUBLE), 0.0)))"


def _field(x: str) -> str:
    return f"(CASE WHEN json_valid({_JSON}) THEN json_extract_string({_JSON}, '$.{x}') END)"


def _first_missing(*names: str) -> str:
    return "CASE " + " ".join(f"WHEN json_extract_string(payload, '$.{n}') IS NULL THEN 'missing {n}'" for n in names) + " END"


def _j(x: str) -> str:
    return f"json_extract_string(payload, '$.{x}')"


_POPULAR = "(SELECT *, score >= 10 AS popular FROM " + feeds._POST + ")"
_FA = f"""WITH q AS (SELECT query_id, terms FROM {feeds._Q}),
r AS (SELECT query_id, secure, name || ' v' || number || ' (' || day || ')' AS label FROM (SELECT *, {_hits("lower(tags || ' ' || name || ' ' || notes)")} AS hits FROM {feeds._REL} x CROSS JOIN q) WHERE hits >= 1),
l AS (SELECT query_id, count(*) AS n, count(*) FILTER (secure = 1) AS ns, list_sort(list(label) FILTER (secure = 1))[1:3] AS s, list_sort(list(label))[1:3] AS a FROM r GROUP BY query_id),
c AS (SELECT query_id, count(*) AS n_cve, list_sort(list(title[1:80]))[1:2] AS c FROM (SELECT *, {_hits('lower(title)')} AS hits FROM {feeds._CVE} x CROSS JOIN q) WHERE hits >= 1 GROUP BY query_id),
p AS (SELECT query_id, count(*) AS n_posts FROM (SELECT *, {_hits('lower(title)')} AS hits FROM {feeds._POST} x CROSS JOIN q) WHERE hits >= 1 GROUP BY query_id),
t AS (SELECT query_id, concat_ws(chr(10), CASE WHEN ns > 0 THEN ns || ' security release(s): ' || array_to_string(s, '; ') ELSE n || ' release(s): ' || array_to_string(a, '; ') END, n_cve || ' advisories: ' || array_to_string(c, '; '), n_posts || ' community post(s)') AS answer FROM q LEFT JOIN l USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN p USING (query_id))
SELECT query_id, CASE WHEN answer = '' THEN 'no results' ELSE answer END AS answer FROM t"""
_TA = f"""WITH t AS (SELECT *, {_TIER} AS tier FROM {_DOCS}),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY pos) AS r, count(*) OVER (PARTITION BY query_id, tier) AS n, '- [' || source || '] ' || title[1:90] || CASE WHEN tier = 1 AND detail <> '' THEN ': ' || detail[1:100] ELSE '' END AS line FROM t),
s AS (SELECT query_id, tier * 2 AS ord, CASE tier WHEN 1 THEN 'VERIFIED SOURCES (' WHEN 2 THEN 'COMMUNITY SOURCES (' ELSE 'OTHER SOURCES (' END || n || ')' || chr(10) || string_agg(line, chr(10) ORDER BY r) AS text FROM n WHERE r <= CASE WHEN tier = 3 THEN 2 ELSE 4 END GROUP BY query_id, tier, n
  UNION ALL SELECT query_id, 3, 'TOP COMMUNITY ANSWER (' || votes || ')' || chr(10) || comment[1:200] FROM {_COMMENT}),
e AS (SELECT query_id, string_agg(text, chr(10) ORDER BY ord) AS answer FROM s GROUP BY query_id)
SELECT query_id, 'Query: ' || query || chr(10) || coalesce(answer, 'NO RESULTS FOUND') AS answer FROM {_values(ANSWER_QUESTIONS, 'query_id, query')} LEFT JOIN e USING (query_id)"""


def _case(mapping: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in mapping.items()) + " END"


ANSWER_SQL = {
    "vendor_hint": f"WITH v AS ({O.vendor_sql(_HINTED)}), h AS (SELECT q.query_id, v.vendor, {_case(D.COMMUNITY_HINTS, 'lower(hint)')} AS hinted FROM {_HINTED} q LEFT JOIN v ON v.query_id = q.query_id) SELECT query_id, coalesce(vendor, hinted) AS vendor, CASE WHEN vendor IS NOT NULL THEN 'named' WHEN hinted IS NOT NULL THEN 'hint' ELSE 'none' END AS stage FROM h",
    "vendor_fanout": f"WITH v AS ({O.vendor_sql(_values(VENDOR_ASKED, 'query_id, query'))}) SELECT query_id, vendor, unnest(({feeds._FAN})[1:3]) AS subreddit FROM v",
    "fuzzy_candidates": f"SELECT query_id, pos, word FROM (SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT query_id, {O.words('query')} AS w FROM {O.QUESTIONS})) WHERE length(word) > 4 AND word NOT IN ({', '.join(map(_s, D.VENDOR_STOP_WORDS))})",
    "post_by_id": "SELECT doc_id, coalesce(source, 'not found') AS found FROM (VALUES (1::BIGINT), (7), (1000000000000)) w(doc_id) LEFT JOIN documents USING (doc_id)",
    "most_negative": f"SELECT post_id, divergence::DOUBLE AS divergence, CASE WHEN divergence > 0.3 THEN 'community disagrees' ELSE 'community agrees' END AS meaning FROM {feeds._POST} WHERE label = 'Negative' ORDER BY divergence DESC, post_id LIMIT 10",
    "best_comment": f"SELECT * FROM {_COMMENT}",
    "vendor_first_context": f"""WITH e AS (SELECT *, '[' || CASE WHEN source IN ('vendor_reddit', 'reddit_live') THEN 'COMMUNITY POST' ELSE 'RELEASE NOTE' END || '] ' || title[1:120] || CASE WHEN detail <> '' THEN ' | ' || detail[1:350] ELSE '' END || CASE WHEN {_CVE_ID} <> '' THEN ' | ' || {_CVE_ID} ELSE '' END AS entry,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN source IN ('vendor_releases', 'vendor_reddit') THEN 0 ELSE 1 END, pos) AS rank FROM {_DOCS})
SELECT query_id, rank, entry FROM e JOIN {_values(ANSWER_QUESTIONS, 'query_id, query')} q USING (query_id) WHERE rank <= 8 AND ({O.any_word('query', D.SECURITY_WORDS)} OR NOT (contains(entry, 'CISA') OR contains(entry, 'CVE-') OR {O.any_word('entry', D.DROPPED_CONTEXT)}))""",
    "readings_page": "SELECT * FROM (SELECT 'room-' || (user_id % 4) AS room, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rank, count(*) OVER (PARTITION BY user_id % 4) AS total, 1 AS page FROM events) WHERE rank <= 25",
    "room_day": "SELECT room, day, o AS on_seconds, 86400 - o AS off_seconds, o / 3600 AS hours_on, o / 86400 * 100 AS pct_on FROM (SELECT 'room-' || (user_id % 4) AS room, strftime(ts, '%Y-%m-%d') AS day, least(count(*) * 60, 86400) AS o FROM events WHERE event_type = 'view' GROUP BY ALL)",
    "first_doc_overlap": f"WITH {O.POSTINGS}, {O.BENCH}, asked AS (SELECT query_id, terms FROM bench UNION ALL SELECT -query_id, {O.tokens('query')} FROM {O.CORPUS}), {O.hits('asked')}, best AS {O.ranked('hits', 1)}, r AS (SELECT a.query_id, a.terms, string_split(d.text, '.')[1] AS title FROM asked a LEFT JOIN best b USING (query_id) LEFT JOIN documents d USING (doc_id)), s AS (SELECT query_id, CASE WHEN title IS NULL THEN 0.0::DOUBLE ELSE least(len(list_intersect(terms, {O.tokens('title')})) / greatest(len(terms), 1), 1.0) END AS quality FROM r) SELECT query_id, quality, quality >= 0.15 AS positive FROM s",
    "signal_bucket_v1": "SELECT event_id, CASE WHEN value / 100 >= 0.6 THEN 'excellent' WHEN value / 100 >= 0.4 THEN 'positive' WHEN value / 100 >= 0.2 THEN 'acceptable' ELSE 'negative' END AS signal FROM events",
    "tier_join": f"SELECT query_id, pos, source, {_NAMES} AS label FROM (SELECT *, {_TIER} AS tier FROM {_DOCS})",
    "verdict_counts": f"SELECT verdict, count(*) AS n, count(*) / {len(X.VERDICTS)} AS share FROM {_values([(v,) for v in X.VERDICTS], 'verdict')} GROUP BY verdict",
    "rewrite_dated": f"SELECT query_id, {O.rewritten('query', [*D.DATED_EXPANSIONS, ('today', f'released {Q.RUN_DATE:%Y-%m-%d}')])} AS rewritten, query || {_s(D.RETRY_SUFFIX)} AS retried FROM {O.QUESTIONS}",
    "class_memory": f"SELECT term, sum(delta) AS score, count(*) AS uses FROM {_DELTAS} GROUP BY term",
    "memory_suffix": f"WITH b AS (SELECT list(term ORDER BY score DESC, term)[1:3] AS best FROM (SELECT term, round(sum(delta), 9) AS score FROM {_DELTAS} GROUP BY term)) SELECT query_id, trim(query || ' ' || array_to_string(list_filter(best, lambda t: NOT contains(lower(query), t)), ' ')) AS query FROM {O.QUESTIONS} CROSS JOIN b",
    "memory_status": f"SELECT count(*) FILTER (quality >= 0.15) + 2 * count(*) FILTER (quality < 0.15) AS queries, 2 * count(*) FILTER (quality < 0.15) AS improvements, count(*) FILTER (quality >= 0.15) AS successes, 2 * count(*) FILTER (quality < 0.15) AS failures, arg_max(rewritten, quality) AS best FROM {_MEM}",
    "agent_retry": f"SELECT query_id, agent, attempt - 1 AS retries, score::DOUBLE AS score, score >= 6 AS passed FROM (SELECT *, row_number() OVER (PARTITION BY query_id, agent ORDER BY score >= 6 DESC, CASE WHEN score >= 6 THEN attempt ELSE -attempt END) AS r FROM {_RUNS} WHERE attempt <= 3) WHERE r = 1",
    "merge_outputs": f"SELECT query_id, CASE WHEN count(*) = 1 THEN min(output) ELSE string_agg('[' || agent || ']:' || chr(10) || output[1:400], chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY agent) END AS answer FROM {_RUNS} WHERE attempt = 1 GROUP BY query_id",
    "judge_labels": f"SELECT id, greatest(0, least(2, coalesce(round_even(try_cast({_field('relevance')} AS DOUBLE), 0), 0)::INT)) AS grade FROM {_REPLY} WHERE id <= 7",
    "answer_scores": f"SELECT id, {_clamp(_field('faithfulness'))} AS faithfulness, {_clamp(_field('answer_relevance'))} AS answer_relevance, CASE WHEN has_gt = 1 AND {_field('correctness')} IS NOT NULL THEN {_clamp(_field('correctness'))} END AS correctness FROM {_REPLY} WHERE id > 7",
    "paired_significance": f"WITH {O.METRICS}, p AS (SELECT query_id, max(CASE WHEN system = 'short' THEN precision_5 END) AS b, max(CASE WHEN system = 'tokens' THEN precision_5 END) AS t FROM metrics GROUP BY query_id), s AS (SELECT count(*) AS n, avg(CAST(t - b AS DOUBLE)) AS mean, stddev_samp(CAST(t - b AS DOUBLE)) AS sd FROM p WHERE b IS NOT NULL AND t IS NOT NULL) SELECT n, mean, mean / (nullif(sd, 0) / sqrt(n)) AS t, mean / nullif(sd, 0) AS d FROM s",
    "sentiment_split": f"SELECT popular, count(*) FILTER (label = 'Negative') AS negative, count(*) FILTER (label = 'Positive') AS positive, count(DISTINCT subreddit) AS communities, coalesce(string_agg('- ' || title[1:55], chr(10) ORDER BY title) FILTER (label = 'Negative'), '') AS issues, coalesce(string_agg('- ' || title[1:55], chr(10) ORDER BY title) FILTER (label = 'Positive'), '') AS updates FROM {_POPULAR} GROUP BY popular",
    "final_answer": _FA,
    "tiered_answer": _TA,
    "agent_scores": f"SELECT query_id, avg(score::DOUBLE) AS mean, count(DISTINCT agent) AS agents FROM {_RUNS} GROUP BY query_id",
    "latency_by_system": f"SELECT system, avg(seconds::DOUBLE) AS mean, count(seconds) AS n FROM {_values(X.LATENCIES, 'system, query_id, seconds')} GROUP BY system",
    "request_rules": f"SELECT id, coalesce(CASE kind WHEN 'sensor' THEN coalesce({_first_missing('room_id', 'light_state', 'lux', 'timestamp')}, CASE WHEN {_j('light_state')} NOT IN ('ON', 'OFF') THEN 'light_state' END) WHEN 'room' THEN coalesce(CASE WHEN {_j('room')} IS NULL OR {_j('room')} NOT IN ({', '.join(map(_s, D.ROOMS))}) THEN 'room' END, {_first_missing('date', 'onSeconds')}) ELSE coalesce({_first_missing('email', 'password')}, CASE WHEN NOT contains({_j('email')}, '@') THEN 'email' END, CASE WHEN length({_j('password')}) < {D.LEAST_PASSWORD} THEN 'password' END) END, 'ok') AS result FROM {_values(X.REQUESTS, 'id, kind, payload')}",
    "dataset_hashes": " UNION ALL ".join(f"SELECT {_s(n)} AS name, sha1({_s('[' + ', '.join(chr(34) + x + chr(34) for x in q) + ']')})[1:12] AS hash" for n, q in DATASETS),
    "provider_specs": f"SELECT spec, CASE WHEN k THEN string_split(spec, ':')[1] ELSE '{X.BACKENDS[0]}' END AS backend, CASE WHEN k THEN spec[strpos(spec, ':') + 1:] ELSE spec END AS model FROM (SELECT spec, contains(spec, ':') AND string_split(spec, ':')[1] IN ({', '.join(map(_s, X.BACKENDS))}) AS k FROM {_values([(s,) for s in X.SPECS], 'spec')})",
    "positional_join": "WITH s AS (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events) SELECT a.user_id, a.n, b.value - a.value AS gain FROM s a JOIN s b ON a.user_id = b.user_id AND a.n = b.n WHERE a.event_type = 'view' AND b.event_type = 'click'",
    "normalised_documents": f"SELECT query_id, pos, sha1(CASE WHEN url <> '' THEN url ELSE title || '|' || source END)[1:12] AS doc_id, coalesce(nullif(detail, ''), nullif(comment, ''), '') AS text FROM {_DOCS}",
}
