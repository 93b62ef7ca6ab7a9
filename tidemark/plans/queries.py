"""Registered queries: each applies an operator to the tables of a folder."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dictionaries as D
from tidemark.functions import text as T
from tidemark.operators import metrics as M
from tidemark.operators import order
from tidemark.operators import retrieve as R
from tidemark.operators import score as S
from tidemark.operators import vendor as V
from tidemark.streaming.memory import stream_memory

RUN_DATE = date(2026, 4, 13)
#: Words that occur in the test tables; the domain's own dictionaries hardly do.
CORPUS_SYNONYMS = {"version": ["version", "release", "license"], "the": ["the", "of"], "und": ["und", "der"]}
CORPUS_QUESTIONS = [(1, "the version"), (2, "und license"), (3, "release of in"), (4, "que la les"), (5, "zzqx nothing")]
CORPUS_VENDORS = [("that", 3), ("with", 3), ("from", 4), ("nicht", 3), ("python", 3), ("grafana", 4)]
MORE_QUESTIONS = [
    (101, "[r/ubuntu] kernel panic after update"), (102, "home assistant stopped on june 3rd, 2025"), (103, "is g6 any good since march 2024"), (104, "Sonoff switch broken 2026-01-05"),
    (105, "build 20240229 of grafana"), (106, "I know nothing"), (107, "money pit, should I switch"), (108, "windows on a mac yesterday"), (109, "what version of edge"), (110, "[r/selfhosted] chrome and firefox last week"),
]
STOP_WORDS = ("the", "and", "for", "with", "are", "was")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, q) for k, q, _, _ in D.QUESTIONS] + MORE_QUESTIONS, "query_id long, query string")


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return b.withColumn("terms", T.tokens(F.col("query")))


def corpus_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORPUS_QUESTIONS, "query_id long, query string").withColumn("terms", T.tokens(F.col("query")))


def everything_asked(spark: SparkSession, d: str) -> DataFrame:
    user = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000).alias("query_id"), F.col("text").alias("query"))
    return questions(spark).unionByName(user)


def title_of(text: Column) -> Column:
    """The first line of a document."""
    return F.substring_index(text, "\n", 1)


def lexical_topk(spark, d):
    return R.ranked(R.token_hits(benchmark(spark, d), table(spark, d, "documents")), 4)


def lexical_topk_nofilter(spark, d):
    q, docs = benchmark(spark, d), table(spark, d, "documents")
    return R.ranked_with_zeros(q, docs, R.token_hits(q, docs), 5)


def topk_with_fallback(spark, d):
    docs = table(spark, d, "documents")
    q = benchmark(spark, d).unionByName(corpus_questions(spark).withColumn("query_id", -F.col("query_id")))
    return R.ranked_or_first(q, docs, R.token_hits(q, docs), 4)


def synonym_expand_topk(spark, d):
    q = corpus_questions(spark).withColumn("terms", T.expand_synonyms(F.col("terms"), CORPUS_SYNONYMS))
    return R.ranked(R.token_hits(q, table(spark, d, "documents")), 5)


def substr_hits_topk(spark, d):
    return R.ranked(R.substring_hits(benchmark(spark, d), table(spark, d, "documents"), least=2), 5)


def hybrid_hits_topk(spark, d):
    q = spark.createDataFrame([(1, "en version"), (2, "src1 license fr"), (3, "de release und")], "query_id long, query string").withColumn("terms", T.tokens(F.col("query")))
    return R.ranked(R.hybrid_hits(q, table(spark, d, "documents"), F.array("source", "lang")), 5)


def rerank_overlap(spark, d):
    docs = table(spark, d, "documents")
    q = benchmark(spark, d)
    best = R.ranked(R.token_hits(q, docs), 8).join(q.select("query_id", F.size("terms").alias("n")), "query_id")
    title = best.join(docs.select("doc_id", T.tokens(title_of(F.col("text"))).alias("title")), "doc_id").join(q.select("query_id", "terms"), "query_id")
    scored = title.withColumn("score", T.overlap_tokens(F.col("terms"), F.col("title")) / F.greatest("n", F.lit(1)))
    return R.top(scored, 4, F.col("score").desc(), F.col("rank"), rank="new_rank").select("query_id", "doc_id", "score", "new_rank")


def rewrite_chain(spark, d):
    every = questions(spark).unionByName(benchmark(spark, d).select("query_id", "query"))
    return every.select("query_id", "query", T.rewrite(F.col("query"), D.EXPANSIONS).alias("rewritten"))


def rewrite_fallback(spark, d):
    rewritten, applied = T.rewrite_applied(F.col("query"), D.SHORT_EXPANSIONS, D.GENERIC_SUFFIX)
    return questions(spark).unionByName(benchmark(spark, d).select("query_id", "query")).select("query_id", rewritten.alias("rewritten"), F.array_join(applied, ",").alias("applied"))


def categorize_docs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(questions(spark).select((-F.col("query_id")).alias("id"), F.col("query").alias("text")))
    return docs.select("id", T.first_match(F.col("text"), D.CATEGORIES, "general").alias("category"))


def signal_bucket(spark, d):
    q = F.col("value") / 100
    return table(spark, d, "events").select("event_id", T.signal(q).alias("signal"), T.confidence(q).alias("confidence"))


def query_type(spark, d):
    return everything_asked(spark, d).select("query_id", T.first_match(F.col("query"), D.QUERY_TYPES, "default").alias("kind"))


def task_router(spark, d):
    return everything_asked(spark, d).select("query_id", T.first_match(F.col("query"), D.AGENTS, "ResearchAgent").alias("agent"))


def subreddit_routing(spark, d):
    route = None
    for found, to in D.SUBREDDITS:
        value = F.array(*map(F.lit, to))
        route = F.when(T.any_word(F.col("query"), found), value) if route is None else route.when(T.any_word(F.col("query"), found), value)
    route = route.otherwise(F.array(*map(F.lit, D.OTHER_SUBREDDITS)))
    return questions(spark).select("query_id", F.posexplode(F.slice(route, 1, 2)).alias("pos", "subreddit"))


def tier_label(spark, d):
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    names = F.when(number <= 6, "releases").when(number <= 11, "github").otherwise("local")
    tier = T.tier(names, D.TIER1, D.TIER2)
    return table(spark, d, "documents").select("doc_id", "source", tier.alias("tier"), T.tier_name(tier).alias("label"))


def subreddit_tag_extract(spark, d):
    asked = everything_asked(spark, d).select("query_id", F.lower(F.regexp_extract("query", r"\[r/(\w+)\]", 1)).alias("tag"))
    return asked.unionByName(table(spark, d, "pages").select((-F.col("page_id")).alias("query_id"), F.lower(F.regexp_extract("url", r"://[^/]+/(\w+)", 1)).alias("tag")))


def doc_id_hash(spark, d):
    return table(spark, d, "pages").select("page_id", T.short_id(F.col("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("web")).alias("hash"))


def page_title_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "[?&]ref=([^&#]*)", 1).alias("ref"))


def json_prop_filter(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", "event_type", k.alias("k")).where("k >= 90")


def keyword_extract(spark, d):
    return benchmark(spark, d).select("query_id", F.array_join(T.keywords(F.col("query"), STOP_WORDS), " ").alias("keywords"), F.array_join(T.long_terms(F.col("query")), " ").alias("long_terms"))


def vendor_extract(spark, d):
    registry = spark.createDataFrame(CORPUS_VENDORS, "vendor string, stage int")
    return V.extract_vendor(questions(spark).unionByName(benchmark(spark, d).select((F.col("query_id") + 1000).alias("query_id"), "query")), registry)


def vendor_fuzzy(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("vendor")).distinct()
    words = names.select(F.concat("vendor", F.lit("s")).alias("word")).unionByName(names.select(F.col("vendor").alias("word")))
    return V.fuzzy_vendor(words, names)


def date_extract(spark, d):
    return questions(spark).select("query_id", V.extract_date(F.col("query"), RUN_DATE).alias("target"))


def asof_release(spark, d):
    events = table(spark, d, "events")
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select(F.col("event_id").alias("release_id"), "user_id", "ts")
    return V.as_of(left, right, "user_id", "ts", "release_id").select("event_id", "user_id", F.col("as_of_id").alias("release_id"))


def canonical_sort(spark, d):
    p = table(spark, d, "part")
    out = V.canonical_order(p, 50, vendor=F.lit("Brand#1"), brand=F.col("p_brand"), name=F.col("p_name"), is_cve=F.col("p_size") > 40, order=[F.col("p_retailprice").desc(), F.col("p_partkey")], canonical=["widget"])
    return out.select("p_partkey", "class", "position")


def community_rerank(spark, d):
    text = F.lower("text")
    hits = T.overlap_substrings(F.array(*map(F.lit, ["the", "und", "que", "version"])), text)
    scored = table(spark, d, "documents").select("doc_id", "n_chars", (hits + F.when(F.contains(F.substring(text, 1, 80), F.lit("the ")), 10).otherwise(0)).alias("relevance"))
    first = scored.orderBy(F.col("relevance").desc(), "doc_id").limit(20)
    return first.withColumn("position", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id")))


def top_comment(spark, d):
    c = table(spark, d, "conversations").withColumn("votes", F.length("text").cast("long"))
    good = c.where("role = 'assistant' and length(text) > 10 and trim(text) not in ('', '[deleted]', '[removed]')")
    best = good.groupBy("conv_id").agg(F.max(F.struct(F.col("votes"), (-F.col("turn")).alias("t"), F.col("text"))).alias("m"))
    own = c.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("o"))
    every = c.select("conv_id").distinct().join(best, "conv_id", "left").join(own, "conv_id", "left")
    return every.select("conv_id", F.coalesce("m.votes", F.lit(0)).cast("long").alias("votes"), F.when(F.col("m.votes") > 0, F.concat(F.lit("TOP: "), F.col("m.text"))).otherwise(F.col("o.text")).alias("comment"))


def tier_boost_merge(spark, d):
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", F.when(number <= 6, 1).when(number <= 11, 2).otherwise(3).alias("tier"), number.alias("source_ord"), F.col("doc_id").alias("position"), "text").where("tier <= 2")
    boosted = T.any_word(title_of(F.col("text")), ["that", "und ", "que "]).cast("int")
    return R.merge_tiers(docs, boosted, 4).select("query_id", "doc_id", "tier", "boosted", "rank")


def conditional_sources(spark, d):
    """General results only for questions that no targeted source answers."""
    q, docs = corpus_questions(spark), table(spark, d, "documents")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    targeted = R.ranked(R.token_hits(q, docs.where((number <= 1) & (F.col("lang") == "es"))), 3).withColumn("origin", F.lit("targeted"))
    general = R.ranked(R.token_hits(q.join(targeted.select("query_id").distinct(), "query_id", "left_anti"), docs), 3).withColumn("origin", F.lit("general"))
    return targeted.unionByName(general)


def context_drop(spark, d):
    """Security notices leave the context of questions that are not about security."""
    docs = table(spark, d, "documents").where(T.any_word(F.col("text"), ["version", "license", "release"]))
    kept = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(~T.any_word(F.col("text"), ["license"])).alias("n_plain"))
    n = F.when(T.any_word(F.col("query"), D.SECURITY_WORDS), F.col("n")).otherwise(F.col("n_plain"))
    return questions(spark).crossJoin(F.broadcast(kept)).select("query_id", n.alias("n_context")).where("n_context > 0")  # one row of counts


def trending_topn(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    k = F.from_json("props", "k int")["k"]
    score = S.trending(F.col("value") / 500, k, F.col("value"), F.col("event_type").isin("error", "signup"), F.col("ts") >= F.col("last") - F.expr("interval 7 days"), F.col("user_id") % 3 == 0)
    return e.join(F.broadcast(last)).select("event_id", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "event_id").limit(50)


def divergence_topn(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.avg(F.when(F.col("role") == "user", F.length("text"))).alias("author"), F.avg(F.when(F.col("role") == "assistant", F.length("text"))).alias("community"))
    gap = F.abs(F.col("author") - F.col("community")) / F.greatest("author", "community")
    out = c.select("conv_id", gap.alias("divergence")).where("divergence is not null").orderBy(F.col("divergence").desc(), "conv_id").limit(10)
    return out.select("conv_id", "divergence", F.when(F.col("divergence") > 0.3, "strong").otherwise("weak").alias("meaning"))


def _results(spark, d):
    docs = table(spark, d, "documents")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    name = F.when(number <= 2, "vendor_releases").when(number <= 4, "vendor_reddit").when(number <= 6, "apple_rss").when(number <= 8, "cve").otherwise("local")
    q = benchmark(spark, d).select("query_id", "query", "terms").unionByName(corpus_questions(spark).select((-F.col("query_id")).alias("query_id"), "query", "terms"))
    best = R.ranked(R.token_hits(q, docs), 4)
    found = best.join(docs.select("doc_id", name.alias("source"), "text"), "doc_id").select("query_id", "source", "text")
    return q.select("query_id", "query").join(found, "query_id", "left")


def quality_floor(spark, d):
    return S.quality_floor(_results(spark, d))


def weighted_coverage(spark, d):
    """Three weightings of the keywords that each language's documents hold, per question."""
    docs = table(spark, d, "documents").withColumn("low", F.lower("text"))
    q = corpus_questions(spark).withColumn("expanded", T.expand_synonyms(F.col("terms"), CORPUS_SYNONYMS))
    pairs = docs.select("lang", "low").join(R.small(q.select("query_id", "terms", "expanded")))
    found = pairs.select("query_id", "lang", "terms", F.explode("expanded").alias("term"), "low").groupBy("query_id", "lang", "term").agg(F.count_if(F.contains(F.col("low"), F.col("term"))).alias("n"))
    by = found.groupBy("query_id", "lang").agg(F.count_if(F.col("n") > 0).alias("matched"), F.max("n").alias("docs"))
    wide = by.groupBy("query_id").agg(*(F.coalesce(F.max(F.when(F.col("lang") == x, F.col(c))), F.lit(0)).alias(f"{c}_{x}") for x in ("en", "de", "fr") for c in ("matched", "docs")))
    joined = wide.join(q.select("query_id", F.size("terms").alias("n")), "query_id")
    total = F.col("docs_en") + F.col("docs_de") + F.col("docs_fr")
    share = lambda x: F.col(f"matched_{x}") / F.greatest("n", F.lit(1))
    v1 = F.least(0.4 * F.least(total / 10.0, F.lit(1.0)) + 0.3 * share("en") + 0.2 * share("de") + F.when(F.col("docs_fr") > 0, 0.1).otherwise(0.0), F.lit(1.0))
    v2 = S.coverage(total, [(0.35, share("en")), (0.25, share("de")), (0.15, share("fr"))], 0.25, 8.0)
    v3 = S.coverage(total, [(0.40, share("en")), (0.25, share("de")), (0.15, share("fr"))], 0.20, 8.0)
    return joined.select("query_id", v1.alias("v1"), v2.alias("v2"), v3.alias("v3"))


def volume_score(spark, d):
    by = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("total"))
    return by.select("source", "lang", S.volume(F.col("total")).alias("score"), (S.volume(F.col("total")) >= 0.3).alias("positive"))


def _attempts(spark, d):
    docs, q = table(spark, d, "documents"), benchmark(spark, d)
    broad = q.withColumn("terms", T.tokens(F.concat("query", F.lit(" the und que software release"))))
    both = q.withColumn("attempt", F.lit(1)).unionByName(broad.withColumn("attempt", F.lit(2)))
    by = ("query_id", "attempt")
    best = R.ranked(R.token_hits(both, docs, by), 1, by).join(both.select(*by, F.size("terms").alias("n")), list(by)).withColumn("share", F.col("hits") / F.col("n"))
    wide = best.groupBy("query_id").agg(*(F.max(F.when(F.col("attempt") == k, F.col("share"))).alias(name) for k, name in ((1, "first"), (2, "second"))))
    return q.select("query_id").join(wide, "query_id", "left").na.fill(0.0, ["first", "second"])


def retry_keep_best(spark, d):
    retried = F.col("first") < 0.75
    return _attempts(spark, d).select("query_id", retried.alias("retried"), F.when(retried, F.greatest("first", "second")).otherwise(F.col("first")).alias("kept"), F.when(retried, F.col("second")).otherwise(F.col("first")).alias("replaced"))


def exactness_rubric(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", S.exactness(k % 5 == 0, k % 2 == 0, k % 3 == 0).alias("quality"))


def sentiment_by_group(spark, d):
    signed = F.when(F.col("event_type").isin("error"), -F.col("value")).otherwise(F.col("value"))
    g = table(spark, d, "events").groupBy("user_id").agg(F.avg(signed / 500).alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "mean", "n", T.sentiment_label(F.col("mean")).alias("label"))


def defect_vs_usability(spark, d):
    docs = table(spark, d, "documents").select(F.length("text").alias("len"), "n_chars", T.any_word(F.col("text"), [*D.DEFECT_WORDS, "the"]).alias("defect"), T.any_word(F.col("text"), [*D.USABILITY_WORDS, "que"]).alias("usability"))
    tagged = docs.select("len", "n_chars", F.explode(F.array_compact(F.array(F.when(F.col("defect"), "defect"), F.when(F.col("usability"), "usability")))).alias("category"))
    return tagged.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), F.avg("n_chars").alias("avg_chars"))


def dataset_overview(spark, d):
    names = table(spark, d, "documents").select("source").distinct().orderBy("source").limit(10)
    few = names.agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("first_sources"))  # ten names
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    counts = docs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"),
        F.countDistinct("source").alias("sources"),
    )
    return counts.crossJoin(F.broadcast(few))  # a row each


def usage_rollup(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("seconds"), F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", (F.col("seconds") / 3600).alias("hours_on"), (F.col("seconds") / 86400 * 100).alias("pct_on"), (86400 - F.col("seconds")).alias("seconds_off"))


def period_stats(spark, d):
    day = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("total"))
    return day.agg(F.sum("total").alias("total"), F.avg("total").alias("per_day"), F.max_by("day", "total").alias("peak"), F.min_by("day", "total").alias("low"))


def _grades(spark, d):
    """Judgements for the questions: a document's label is its grade for every question that retrieves it."""
    labels = table(spark, d, "labels")
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)
    return labels.select("doc_id", grade.alias("grade"))


def _rankings(spark, d):
    """Rankings of two systems, from one pass over the documents."""
    docs, q = table(spark, d, "documents"), benchmark(spark, d)
    both = q.withColumn("system", F.lit("tokens")).unionByName(q.withColumn("terms", F.slice("terms", 1, 6)).withColumn("system", F.lit("short")))
    by = ("query_id", "system")
    return R.ranked(R.token_hits(both, docs, by), 6, by).select("query_id", "doc_id", "rank", "system")


def ir_metrics(spark, d):
    none = spark.createDataFrame([(-1,)], "query_id long")
    q = benchmark(spark, d).select("query_id").unionByName(none)
    systems = spark.createDataFrame([("tokens",), ("short",)], "system string")
    rankings = _rankings(spark, d)
    judged = rankings.select("query_id", "doc_id").distinct().join(_grades(spark, d), "doc_id").select("query_id", "doc_id", "grade")
    return M.ir_metrics(rankings, judged, q.join(F.broadcast(systems)), by=("query_id", "system"))


def pooled_qrels(spark, d):
    """Documents of all systems, the first system's row of each, and whether a judgement is known."""
    order = F.when(F.col("system") == "tokens", 0).otherwise(1)
    first = _rankings(spark, d).groupBy("query_id", "doc_id").agg(F.min(F.struct(order.alias("o"), F.col("system"), F.col("rank"))).alias("m"))
    known = _grades(spark, d)
    return first.join(known, "doc_id", "left").select("query_id", "doc_id", "m.system", "m.rank", F.col("grade").isNull().alias("to_judge"))


def mean_ci_by_system(spark, d):
    long = M.long_form(ir_metrics(spark, d), ["query_id", "system"], ["mrr", "recall_3", "precision_3", "ndcg_3"])
    return long.groupBy("system", "metric").agg(*M.mean_ci(F.col("value")))


def grouping_sets_report(spark, d):
    return table(spark, d, "events").groupingSets([["event_type"], ["event_type", "user_id"]], "event_type", "user_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def metric_pivot(spark, d):
    long = M.long_form(ir_metrics(spark, d), ["query_id", "system"], ["mrr", "ndcg_1", "ndcg_3", "ndcg_5"])
    return long.groupBy("system").pivot("metric", ["mrr", "ndcg_1", "ndcg_3", "ndcg_5"]).agg(F.avg("value"))


def paired_comparison(spark, d):
    rows = ir_metrics(spark, d).groupBy("query_id").pivot("system", ["short", "tokens"]).agg(F.max("ndcg_3"))
    return M.paired(rows.withColumn("category", F.col("query_id") % 4), "short", "tokens", ("category",))


def tertile_gain(spark, d):
    e = order.numbered(table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "value"), "event_id")
    return M.tertile_gain(e, "seq", "value", e.count())


def _memory(spark, d):
    rows = questions(spark).unionByName(benchmark(spark, d).select((F.col("query_id") + 1000).alias("query_id"), "query"))
    rewritten = F.concat(T.rewrite(F.col("query"), D.EXPANSIONS), F.lit(" "), F.array_join(F.transform(F.slice(T.words(F.col("query")), 1, 2), lambda w: F.concat(F.lit("re"), w)), " "))
    rows = rows.select("query_id", "query", rewritten.alias("rewritten"), (F.length("query") % 10 / 10.0).alias("quality"))
    return rows, S.memory_deltas(rows, "query_id", F.col("query"), F.col("rewritten"), F.col("quality"))


def memory_scores(spark, d):
    return S.memory_scores(_memory(spark, d)[1], "query_id")


def memory_best(spark, d):
    total = _memory(spark, d)[1].groupBy("term").agg(F.sum("delta").alias("score"))
    return total.orderBy(F.col("score").desc(), "term").limit(10)


def memory_curve(spark, d):
    rows, deltas = _memory(spark, d)
    return S.memory_curve(rows, deltas, "query_id")


def crm_lookup(spark, d):
    crm = spark.createDataFrame([("ORD-001", "Alice Chen", "active"), ("ORD-002", "Bob Smith", "cancelled"), ("ORD-003", "Carol Wu", "active")], "order_id string, customer string, status string")
    asked = spark.createDataFrame([(1, "where is ORD-001"), (2, "refund ord-002 please ORD-002"), (3, "ORD-999?"), (4, "no id")], "id long, message string")
    rows = asked.withColumn("order_id", F.regexp_extract("message", r"ORD-\d+", 0))
    return rows.join(F.broadcast(crm), "order_id", "left").select("id", "order_id", F.coalesce("customer", F.lit("unknown")).alias("customer"), F.coalesce("status", F.lit("not found")).alias("status"))


def request_validation(spark, d):
    """The first rule that each order breaks."""
    o = table(spark, d, "orders")
    error = F.when(F.col("o_orderpriority").isNull(), "missing").when(~F.col("o_orderstatus").isin("F", "O"), "status").when(F.col("o_totalprice") < 1000, "price")
    return o.select("o_orderkey", error.alias("error")).where("error is not null")


def template_answer(spark, d):
    """The three best documents of each question as one text."""
    docs = table(spark, d, "documents")
    best = R.ranked(R.token_hits(corpus_questions(spark), docs), 3).join(docs.select("doc_id", "source", F.regexp_replace(F.substring("text", 1, 80), r"[\n]", " ").alias("snippet")), "doc_id")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "snippet", F.lit(" ["), "source", F.lit("]"))
    return best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")).select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("answer"))


def badge_counts(spark, d):
    k = F.from_json("props", "k int")["k"]
    tags = F.array_compact(F.array(F.when(k % 3 == 0, "SECURITY"), F.when(k % 4 == 0, "BREAKING")))
    return table(spark, d, "events").select(T.badge(F.col("event_type") == "error", tags).alias("badge")).groupBy("badge").agg(F.count(F.lit(1)).alias("n"))


def embedding_topk(spark, d):
    """Nearest vectors by cosine of every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = e.select("vec_id", F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))).alias("v"))
    asked = unit.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = R.against(unit, asked, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", dot(F.col("v"), F.col("q")).alias("cosine"))
    return R.top(pairs, 5, F.col("cosine").desc(), F.col("vec_id")).select("query_id", "vec_id", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        lexical_topk, lexical_topk_nofilter, topk_with_fallback, synonym_expand_topk, substr_hits_topk, hybrid_hits_topk, rerank_overlap, rewrite_chain, rewrite_fallback,
        categorize_docs, signal_bucket, query_type, task_router, subreddit_routing, tier_label, subreddit_tag_extract, doc_id_hash, page_title_extract, json_prop_filter, keyword_extract,
        vendor_extract, vendor_fuzzy, date_extract, asof_release, canonical_sort, community_rerank, top_comment, tier_boost_merge, conditional_sources, context_drop, trending_topn, divergence_topn,
        quality_floor, weighted_coverage, volume_score, retry_keep_best, exactness_rubric, sentiment_by_group, defect_vs_usability, dataset_overview, usage_rollup, period_stats,
        ir_metrics, pooled_qrels, mean_ci_by_system, grouping_sets_report, metric_pivot, paired_comparison, tertile_gain, memory_scores, memory_best, memory_curve,
        crm_lookup, request_validation, template_answer, badge_counts, embedding_topk, stream_memory,
    )
}
