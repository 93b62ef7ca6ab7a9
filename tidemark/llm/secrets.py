"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Spans come from three base kinds and some more specific ones. Every found value is hashed and counted over
the whole corpus by the distinct repositories and owners that hold it: what many owners hold is a copied
example, what one or few hold looks live. Long mixed tokens without any context are spans only if they
look live in this sense.

Positions are code points. They follow from the pieces between the matches, so one regular expression
pass gives all of them.

Defined cases: null texts count as empty; a null owner or repository counts as one more owner; repeated
rows each give their row; an empty table gives an empty result. Columns besides id, text, owner and
repository are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared

#: A value that more owners hold is an example.
MOST_OWNERS = 2
#: Matches of a text that are taken together, values that are widely copied, and the share of all spans from which a value is.
_CHUNK = 256
HOT_SPANS = 100_000
HOT_SHARE = 10_000
_SPAN = "struct<start:int,ord:int,kind:string,stop:int,value:bigint>"


@dataclass(frozen=True)
class Kind:
    """``group``: the regular expression's group with the value, which has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    live_only: bool = False


# The base kinds. Matches are leftmost and do not overlap. Of access and hex a match is
# a whole run, so the least length can stand in the pattern.
BASE = (
    Kind("assign", r"((?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds, after the base kinds in order.
MORE = (
    Kind("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Kind("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Kind("chat_bot", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Kind("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Kind("mixed", r"\b(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", live_only=True),
)


def spans(text: Column, kind: Kind, order: int) -> Column:
    """Array of the kind's spans in the text."""
    none = F.array().cast(f"array<{_SPAN}>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda p: F.length(p))
    parts = F.slice(F.arrays_zip(gaps.alias("gap"), found.alias("match"), value.alias("value")), F.lit(1), F.size(found))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        stop = start + F.length(part["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), stop.alias("stop"), F.xxhash64(part["value"]).alias("value")).cast(_SPAN)
        kept = F.when(F.length(part["value"]) >= kind.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]) if kind.least else F.concat(acc["out"], F.array(span))
        return F.struct(stop.alias("at"), kept.alias("out"))

    def chunk(number: Column) -> Column:
        """Spans of some matches, from the end of the matches before."""
        return F.aggregate(F.slice(parts, number * _CHUNK + 1, F.lit(_CHUNK)), start, step)

    def moved(acc: Column, more: Column) -> Column:
        shift = lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), (s["stop"] + acc["at"]).alias("stop"), s["value"].alias("value"))
        return F.struct((acc["at"] + more["at"]).alias("at"), F.concat(acc["out"], F.transform(more["out"], shift)).alias("out"))

    # an array grows by copying, so the matches of a text are first taken in chunks
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int")), chunk)
    whole = F.aggregate(chunks, start, moved, lambda acc: acc["out"])
    return F.when(text.rlike(kind.pattern), whole).otherwise(none)


def digest(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined by start, then kind in order."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories, n: in how many distinct ones each value occurs, and how often. ``found``: value, owner, repository."""
    repositories = found.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = repositories.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """doc_id, _base (spans of the base kinds), _all (all spans), n_live and n_example for every row."""
    owner = F.lit("") if owner is None else owner
    repository = owner if repository is None else repository
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"))
    arrays = rows
    for order, kind in enumerate(BASE + MORE):
        arrays = arrays.withColumn(f"_k{order}", spans(F.col("text"), kind, order))
    base = F.concat(*(F.col(f"_k{k}") for k in range(len(BASE))))
    more = F.concat(*(F.col(f"_k{k}") for k in range(len(BASE), len(BASE + MORE))))
    found = shared.written(arrays.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "owner", "repository", base.alias("_base"), more.alias("_more")), "spans")
    every = found.select("_row", "owner", "repository", F.explode(F.concat("_base", "_more")).alias("span"))
    counts = shared.written(ownership(every.select(F.col("span.value").alias("value"), "owner", "repository")), "ownership")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_SPANS, total // HOT_SHARE)  # HOT_SHARE values at most, so they are sent to all tasks
    spans_of = every.select("_row", "span", F.col("span.value").alias("value"))
    often, rest = counts.where(hot), counts.where(~hot)
    judged = spans_of.join(F.broadcast(often), "value").unionByName(spans_of.join(rest, "value"))
    live = F.col("owners") <= most_owners
    only = F.col("span.ord").isin([k for k, kind in enumerate(BASE + MORE) if kind.live_only])
    by_row = judged.groupBy("_row").agg(
        F.collect_list(F.when((F.col("span.ord") >= len(BASE)) & (live | ~only), F.col("span"))).alias("_kept"),  # at most a row's own spans
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_example"),
    )
    out = found.join(by_row, "_row", "left")
    kept = F.coalesce("_kept", F.array().cast(f"array<{_SPAN}>"))
    return out.select("doc_id", "_base", F.concat("_base", kept).alias("_all"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Base counts and digest, all spans, and live-looking and example counts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", *(_count(k).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)), F.sha2(digest(F.col("_base")), 256).alias("base_sha256"), digest(F.col("_all")).alias("spans"), "n_live", "n_example")


def _count(order: int) -> Column:
    return F.size(F.filter("_base", lambda s: s["ord"] == order)).cast("long")
