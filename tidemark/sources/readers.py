"""Scans of the retrieval domain's feeds as DataFrames with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import retrieve as R

RELEASE = "versionSearchTags array<string>, versionProductName string, versionProductBrand string, versionNumber string, versionReleaseNotes string, versionReleaseDate string, versionReleaseChannel string, versionReleaseTags array<string>, versionUrl string, isCve boolean, classification struct<securityType: array<string>, breakingType: array<string>>"
POST = "title string, subreddit string, url string, score int, created_utc string, upvote_ratio double, num_comments int, author_description string, first_author_comment string, comments array<struct<id: string, body: string, score: int, author: string>>, metadata struct<predicted: struct<positiveScore: double>>"
ANALYZED = "all_analyzed_posts array<struct<post_id: string, title: string, subreddit: string, url: string, score: int, num_comments: int, title_sentiment: struct<label: string>, metrics: struct<sentiment_divergence: double, author_avg_sentiment: double, community_avg_sentiment: double>>>"
KEV = "vulnerabilities array<struct<vendorProject: string, product: string, vulnerabilityName: string, shortDescription: string, cveID: string, dateAdded: string, requiredAction: string>>"
QUESTION = "id string, query string, question string, title string, category string, ground_truth string, gt string"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(value): whole files as texts."""
    return spark.read.text(path, wholetext=True)


def releases(spark: SparkSession, path: str) -> DataFrame:
    return release_rows(payloads(spark, path))


def release_rows(texts: DataFrame) -> DataFrame:
    """Releases of payloads (value) that map vendors to lists of them; notes may be a text or a list of texts."""
    kind = f"map<string, array<struct<{_fields(RELEASE)}>>>"
    listed = texts.select(F.explode(F.from_json("value", kind)).alias("vendor", "rows")).select("vendor", F.explode("rows").alias("r"))
    notes = F.coalesce(F.array_join(F.from_json("versionReleaseNotes", "array<string>"), " "), F.col("versionReleaseNotes"))
    return listed.select("vendor", "r.*").withColumn("versionReleaseNotes", F.coalesce(notes, F.lit("")))


def best_hits(rows: DataFrame, questions: DataFrame, body: Column, order: Sequence[Column], *, least: int = 1, limit: int = 5) -> DataFrame:
    """The rows of a feed with the most of each question's ``terms`` as substrings of ``body``, ranked.

    Feeds are read whole; the questions are sent to all tasks if they are small."""
    pairs = rows.join(R.small(questions.select("query_id", "terms")))
    scored = pairs.withColumn("hits", T.overlap_substrings(F.col("terms"), F.lower(body))).where(F.col("hits") >= least)
    return R.top(scored, limit, F.col("hits").desc(), *order)


def json_rows(texts: DataFrame, schema: str) -> DataFrame:
    """Rows of payloads (value) that are a list, or an object with the list under ``data``."""
    listed = F.coalesce(F.from_json("value", f"struct<data: array<{schema}>>")["data"], F.from_json("value", f"array<{schema}>"))
    return texts.select(F.explode(listed).alias("r")).select("r.*")


def known_exploited_rows(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.from_json("value", f"struct<{_fields(KEV.replace('vulnerabilities array', 'vulnerabilities: array'))}>")["vulnerabilities"]).alias("v")).select("v.*")


def _fields(schema: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) (?=[a-z])", r"\1\2: ", schema)


def release_documents(rows: DataFrame, terms: Column, least: int = 2, limit: int = 5) -> DataFrame:
    """The releases with most terms in tags, name and notes, as retrieved documents."""
    body = F.lower(F.concat_ws(" ", F.array_join("versionSearchTags", " "), "versionProductName", "versionReleaseNotes"))
    secure = F.array_contains("classification.securityType", "SECURITY")
    scored = rows.withColumn("hits", T.overlap_substrings(terms, body)).where(F.col("hits") >= least)
    out = scored.orderBy(F.col("hits").desc(), "versionProductName", "versionNumber").limit(limit)
    return out.select(F.concat_ws(" ", "versionProductName", "versionNumber").alias("title"), F.when(secure, "Negative").otherwise("Neutral").alias("sentiment"), F.lit("releases").alias("source"), F.col("versionUrl").alias("url"), F.col("versionReleaseDate").alias("date"), "hits")


def posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POST).json(path, multiLine=True)


def post_documents(rows: DataFrame, terms: Column, limit: int = 5) -> DataFrame:
    body = F.lower(F.concat_ws(" ", "title", "subreddit"))
    scored = rows.withColumn("hits", T.overlap_substrings(terms, body)).where("hits > 0")
    label = F.when(F.col("metadata.predicted.positiveScore") > 0.5, "Positive").otherwise("Neutral")
    return scored.orderBy(F.col("hits").desc(), "title").limit(limit).select("title", "subreddit", label.alias("sentiment"), "score", F.lit("reddit_live").alias("source"), "url", F.substring("created_utc", 1, 10).alias("date"), "hits")


def analyzed_posts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ANALYZED).json(path, multiLine=True)
    return rows.select(F.explode("all_analyzed_posts").alias("p")).select("p.*").withColumn("sentiment", F.initcap("title_sentiment.label"))


def known_exploited(spark: SparkSession, path: str, query: str, least: int = 2, limit: int = 3) -> DataFrame:
    """Entries of a catalogue of exploited vulnerabilities with at least ``least`` of the question's words."""
    rows = spark.read.schema(KEV).json(path, multiLine=True).select(F.explode("vulnerabilities").alias("v")).select("v.*")
    body = F.lower(F.concat_ws(" ", "vendorProject", "product", "vulnerabilityName", "shortDescription"))
    scored = rows.withColumn("hits", T.overlap_substrings(T.tokens(T.strip_marks(F.lit(query))), body)).where(F.col("hits") >= least)
    return scored.orderBy(F.col("hits").desc(), "cveID").limit(limit)


def feed_items(documents: DataFrame, column: str = "value") -> DataFrame:
    """title, link, published, summary (of RSS the source), pos of the items of RSS texts and the entries of Atom texts, one text a row."""
    text = F.col(column)
    rss = F.arrays_zip(F.xpath(text, F.lit("//item/title/text()")).alias("title"), F.xpath(text, F.lit("//item/link/text()")).alias("link"), F.xpath(text, F.lit("//item/pubDate/text()")).alias("published"), F.xpath(text, F.lit("//item/source/text()")).alias("summary"))
    atom = F.arrays_zip(F.xpath(text, F.lit("//*[local-name()='entry']/*[local-name()='title']/text()")).alias("title"), F.xpath(text, F.lit("//*[local-name()='entry']/*[local-name()='link']/@href")).alias("link"), F.xpath(text, F.lit("//*[local-name()='entry']/*[local-name()='updated']/text()")).alias("published"), F.xpath(text, F.lit("//*[local-name()='entry']/*[local-name()='summary']/text()")).alias("summary"))
    return documents.select(F.posexplode(F.concat(rss, atom)).alias("pos", "i")).select("i.*", "pos")


def questions(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """id, query, category, ground_truth: the first of several names for each field, blanks as null, rows without a question dropped."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = rows.select("id", F.coalesce(blank("query"), blank("question"), blank("title")).alias("query"), "category", F.coalesce(blank("ground_truth"), blank("gt")).alias("ground_truth")).where("query is not null")
    return out if limit is None else out.orderBy("id").limit(limit)


def harvest(sources: list[DataFrame], target: int) -> DataFrame:
    """Titles of several sources in order of priority, each title once, categorised, at most ``target``."""
    from tidemark.functions import dictionaries as D

    every = None
    for k, s in enumerate(sources):
        part = s.select("title", F.lit(k).alias("priority"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("title").agg(F.min("priority").alias("priority")).orderBy("priority", "title").limit(target)
    return first.select("title", T.first_match(F.col("title"), D.CATEGORIES, "general").alias("category"), F.row_number().over(Window.orderBy("priority", "title")).alias("id"))
