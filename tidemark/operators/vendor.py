"""Vendor and date extraction, as-of lookup, canonical order and community ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dictionaries as D
from tidemark.functions import text as T


def _table(df: DataFrame, stage: int, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(stage, k, a, v) for k, (a, v) in enumerate(pairs)], "stage int, ord int, alias string, vendor string")


def extract_vendor(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """query_id, vendor: the best vendor that each question names. ``registry``: vendor, stage (3 names, 4 communities).

    A ladder: a phrase ends the search; else the community prefix and all aliases count; else exact words.
    The dictionaries are substrings of the question, so they are sent to all tasks; the registry is joined
    on words. Ties between exact words go by their place in the question.
    """
    low = questions.select("query_id", F.lower("query").alias("q"))
    names = _table(questions, 0, D.PHRASE_VENDORS).unionByName(_table(questions, 2, D.ALIAS_VENDORS))  # fixed size
    named = low.join(F.broadcast(names), F.contains(F.col("q"), F.col("alias"))).select("query_id", "q", "stage", "ord", "vendor")
    short = low.where(F.array_contains(T.words(F.col("q")), "g6")).select("query_id", "q", F.lit(0).alias("stage"), F.lit(len(D.PHRASE_VENDORS)).alias("ord"), F.lit("Ubiquiti").alias("vendor"))
    prefix = low.withColumn("alias", F.regexp_extract("q", r"^\s*\[r/(\w+)\]", 1))
    communities = _table(questions, 1, D.SUBREDDIT_VENDORS)
    by_prefix = prefix.join(F.broadcast(communities), "alias").select("query_id", "q", "stage", "ord", "vendor")
    words = low.select("query_id", "q", F.posexplode(T.words(T.strip_marks(F.col("q")))).alias("ord", "word")).where(F.length("word") > 3)
    exact = words.join(registry, words.word == registry.vendor).select("query_id", "q", "stage", "ord", "vendor")
    every = named.unionByName(short).unionByName(by_prefix).unionByName(exact)
    # stages 1 and 2 are looked at together; a stage counts only if no earlier one has found anything
    rung = F.when(F.col("stage") == 0, 0).when(F.col("stage") <= 2, 1).otherwise(F.col("stage"))
    ladder = every.withColumn("rung", rung).withColumn("first", F.min("rung").over(Window.partitionBy("query_id"))).where("rung = first")
    score = F.when(F.col("rung") == 0, 0).when(F.contains(F.col("q"), F.lower("vendor")), 0).when(F.col("stage") == 2, 1).otherwise(2)
    best = ladder.groupBy("query_id", "vendor").agg(F.min(F.struct(score.alias("score"), F.col("stage"), F.col("ord"))).alias("at"))
    window = Window.partitionBy("query_id").orderBy("at.score", "at.stage", "at.ord", "vendor")
    return best.withColumn("r", F.row_number().over(window)).where("r = 1").select("query_id", "vendor")


def fan_out(vendors: DataFrame, most: int = 3) -> DataFrame:
    """query_id, vendor, subreddit: the first communities of each question's vendor."""
    known = F.create_map(*(x for v, subs in D.VENDOR_COMMUNITIES.items() for x in (F.lit(v), F.array(*map(F.lit, subs)))))
    subs = F.coalesce(F.element_at(known, F.col("vendor")), F.array("vendor"))
    return vendors.select("query_id", "vendor", F.explode(F.slice(subs, 1, most)).alias("subreddit"))


def with_hint(questions: DataFrame, vendors: DataFrame) -> DataFrame:
    """query_id, vendor, stage of all questions (query_id, hint): the last rung of the ladder, where the others
    find nothing, is the vendor of the community that a question comes from."""
    hints = F.create_map(*(F.lit(x) for pair in D.COMMUNITY_HINTS.items() for x in pair))
    rows = questions.select("query_id", "hint").join(vendors, "query_id", "left")
    return rows.select("query_id", F.coalesce("vendor", F.element_at(hints, F.lower("hint"))).alias("vendor"), F.when(F.col("vendor").isNotNull(), "named").when(F.element_at(hints, F.lower("hint")).isNotNull(), "hint").otherwise("none").alias("stage"))


def fuzzy_words(questions: DataFrame) -> DataFrame:
    """query_id, pos, word: the words of a question that may name a vendor by likeness."""
    words = questions.select("query_id", F.posexplode(T.words(F.col("query"))).alias("pos", "word"))
    return words.where((F.length("word") > 4) & ~F.col("word").isin(D.VENDOR_STOP_WORDS))


def fuzzy_vendor(words: DataFrame, registry: DataFrame, *, cutoff: float = 0.92, most_names: int = 200_000) -> DataFrame:
    """word, vendor, ratio: the most similar registered name by matching blocks, if it reaches the cutoff.

    Ratio 2 M / T needs lengths within (2 - cutoff) / cutoff of each other, and such names are compared in
    batches. The registry is a dimension: more than ``most_names`` names are refused.
    """
    names = [r.vendor for r in registry.select("vendor").distinct().limit(most_names + 1).collect()]
    if len(names) > most_names:
        raise ValueError(f"the registry has over {most_names} names")
    by_length: dict[int, list[str]] = {}
    for n in sorted(names):
        by_length.setdefault(len(n), []).append(n)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for frame in batches:
            out = []
            for word in frame["word"]:
                best = (0.0, "")
                low, high = int(len(word) * cutoff / (2 - cutoff)), int(len(word) * (2 - cutoff) / cutoff) + 1
                matcher = SequenceMatcher(b=word)
                for n in (n for size in range(low, high + 1) for n in by_length.get(size, ())):
                    matcher.set_seq1(n)
                    if matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff and (r := matcher.ratio()) >= cutoff:
                        best = max(best, (r, n))
                if best[1]:
                    out.append((word, best[1], best[0]))
            yield pd.DataFrame(out, columns=["word", "vendor", "ratio"])

    return words.select("word").distinct().mapInPandas(match, "word string, vendor string, ratio double")


def extract_date(query: Column, run_date: date) -> Column:
    """The date that a question asks for as YYYYMMDD: relative words first, then written dates; or null."""
    q = F.lower(query)
    out = None
    for word, days in D.RELATIVE_DATES:
        then = F.date_format(F.date_sub(F.lit(run_date), days), "yyyyMMdd")
        out = F.when(F.contains(q, F.lit(word)), then) if out is None else out.when(F.contains(q, F.lit(word)), then)
    for name, number in D.MONTHS:
        day, month = rf"{name}\s*(\d{{1,2}})(?:st|nd|rd|th)?[,\s]+(\d{{4}})", rf"{name}[,\s]+(\d{{4}})"
        out = out.when(q.rlike(day), F.concat(F.regexp_extract(q, day, 2), F.lit(f"{number:02d}"), F.lpad(F.regexp_extract(q, day, 1), 2, "0")))
        out = out.when(q.rlike(month), F.concat(F.regexp_extract(q, month, 1), F.lit(f"{number:02d}01")))
    iso, plain = r"(\d{4})-(\d{2})-(\d{2})", r"\b(20\d{6})\b"
    out = out.when(q.rlike(iso), F.concat(*(F.regexp_extract(q, iso, k) for k in (1, 2, 3))))
    return out.when(q.rlike(plain), F.regexp_extract(q, plain, 1))


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, right_id: str) -> DataFrame:
    """Each left row with the id of the latest right row of its key at or before its time, or null.

    One union and one running maximum for each key: no pair of rows is made. A key with a large share of
    all rows is one window group, so keys are spread by day first: within a day the maximum runs, and days
    hand on their last row.
    """
    day = F.to_date(time)
    both = left.select(by, time, F.lit(1).alias("side"), *(c for c in left.columns if c not in (by, time)))
    marks = right.select(by, time, F.lit(0).alias("side"), F.struct(F.col(time), F.col(right_id)).alias("seen"))
    every = both.unionByName(marks, allowMissingColumns=True).withColumn("day", day)
    inside = Window.partitionBy(by, "day").orderBy(time, "side", F.col("seen").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    running = every.withColumn("last", F.max("seen").over(inside))
    days = every.groupBy(by, "day").agg(F.max("seen").alias("day_last"))
    before = days.withColumn("before", F.max("day_last").over(Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select(by, "day", "before")
    found = running.where("side = 1").join(before, [by, "day"], "left").withColumn("last", F.coalesce("last", "before"))
    return found.select(*left.columns, F.col(f"last.{right_id}").alias("as_of_id"), F.col(f"last.{time}").alias("as_of_time"))


def canonical_order(rows: DataFrame, limit: int, *, vendor: Column, brand: Column, name: Column, is_cve: Column, order: list[Column], canonical: Sequence[str]) -> DataFrame:
    """The first ``limit`` rows in the given order, then sorted: canonical names, exact brand, others, CVEs.

    The limit comes before the sort, as callers rely on."""
    low_brand, low_name = F.lower(brand), F.lower(name)
    known = F.lit(False)
    for c in canonical:
        known = known | F.contains(low_brand, F.lit(c)) | F.contains(low_name, F.lit(c))
    score = F.when(known, 0).when(low_brand == F.lower(vendor), 1).when(is_cve, 3).otherwise(2)
    first = rows.withColumn("class", score).orderBy(*order).limit(limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy("class", *order)))
