"""Soft-membership mixing to target weights, in DataFrame operations only.

A multinomial logistic model over words present and binned text statistics, learnt from a labelled table,
gives every document posteriors over the domains. Spark counts the features, chooses those whose G statistic
is significant (the ``features_a_domain`` most significant for each domain) and lists which of them the at
most ``sample_rows`` labelled rows have; the driver fits the weights on that list. Nonnegative rates x minimise
r' S r, where r_k = sum_d tokens_d p_dk x_d - t_k is what domain k has beyond its target and S weighs the
domains. Each round of accelerated projected gradient, in the metric that weighs a document by its tokens,
is x_d <- max(0, y_d - sum_k p_dk (S r)_k): one aggregation over the documents to a number for each domain.
The rounds' numbers are literals of the next plan, so nothing is iterated over rows outside Spark and no
state per document is kept between rounds. Rounds end at the tolerance or where they no longer change
anything; what is left of r is returned with the rates.

Defined cases: null text counts as empty and has no tokens, and gets a rate from its posteriors like any
other; labels that are null or of an unknown domain, and labels without a document, are not learnt from;
repeated rows count as often as they occur; an empty table gives an empty result; without labels all
domains are equally likely. Columns besides the id and the text are passed through or ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared

#: Most labelled rows that the classifier is fitted on, those with the least hashes of their ids.
SAMPLE_ROWS = 10_000
#: Most features for each domain, those with the highest G. On 10,000 rows some 800 significant ones lean to toxic;
#: with all of them 2135 of 2162 toxic texts are recognised, with this bound 2138, and no clean one is mistaken.
FEATURES_A_DOMAIN = 400
LEAST_DOCUMENTS = 2
#: Least G statistic of a feature's table of domain and presence; by chance one of two thousand words has it.
LEAST_G = 12
#: A word counts if the share of documents with it is so many times as high inside a domain as outside.
LEAST_LIFT = 2
#: Weight of the squared weights against the log likelihood of all rows.
PENALTY = 0.1
ROUNDS = 30
#: Rounds without a gain of a hundredth after which nothing more is expected.
STALL = 6
TOLERANCE = 1e-4
_MARK = "\x01"
_SYMBOLS = "!#$%&*|"
#: Domains of the table labels.
LABEL_DOMAINS = ("clean", "poor", "toxic")
MIX_TARGETS = {"clean": 0.9, "poor": 0.1, "toxic": 0.0}
FILTER_TARGETS = {"clean": 1.0, "toxic": 0.0}


def label_domains(labels: DataFrame, poor: str = "poor") -> DataFrame:
    """(doc_id, domain) of the table labels: toxic, else poor (under the given name) or clean by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, poor).when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def _describe(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _tokens (words in the text), _kinds (distinct words) and _marks (binned statistics)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[\x09-\x0D\p{Punct} ]+"), lambda w: w != "")
    df = docs.withColumn("_words", words).withColumn("_kinds", F.array_distinct("_words"))
    variety = F.floor(9 * F.size("_kinds") / F.greatest(F.size("_words"), F.lit(1)))
    length = F.least(F.floor(F.log2(F.size("_words") + F.lit(1))), F.lit(14))  # long texts repeat words anyway
    symbols = F.least(F.floor(50 * (1 - F.length(F.translate(text, _SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1)))), F.lit(9))
    marks = F.array(F.lit(f"{_MARK}all"), F.concat_ws("-", F.lit(f"{_MARK}variety"), variety.cast("string"), length.cast("string")), F.concat(F.lit(f"{_MARK}symbols"), symbols.cast("string")))
    return df.withColumn("_tokens", F.size("_words").cast("double")).withColumn("_marks", marks).drop("_words")


def _fit_weights(rows: list[np.ndarray], domain: np.ndarray, n_features: int, n_domains: int, penalty: float = PENALTY, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature x domain) and constants of a multinomial logistic model, by limited-memory BFGS.

    ``rows``: the features that each row has. The constants are drawn to the log shares of the domains."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    which = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    prior = np.log((np.bincount(domain, minlength=n_domains) + 1) / (n + n_domains))
    known = np.eye(n_domains)[domain] if n else np.zeros((0, n_domains))
    size = n_features * n_domains

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        weights = w[:size].reshape(n_features, n_domains)
        z = prior + w[size:] + np.stack([np.bincount(at, weights[which, k], n) for k in range(n_domains)], axis=1)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        apart = p - known
        down = np.stack([np.bincount(which, apart[at, k], n_features) for k in range(n_domains)], axis=1)
        value = -np.log(np.maximum((p * known).sum(axis=1), 1e-300)).sum() + penalty / 2 * (w @ w)
        return float(value), np.concatenate((down.ravel(), apart.sum(axis=0))) + penalty * w

    w = np.zeros(size + n_domains)
    if not n:
        return w[:size].reshape(n_features, n_domains), prior
    now, slope = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, taken = slope.copy(), []
        for s, y in reversed(moves):
            taken.append((s @ way) / (y @ s))
            way -= taken[-1] * y
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(moves, reversed(taken)):
            way += s * (a - (y @ way) / (y @ s))
        step = 1.0
        while True:
            then, steeper = loss(w - step * way)
            if then <= now - 1e-4 * step * (slope @ way) or step < 1e-9:
                break
            step /= 2
        s, y = -step * way, steeper - slope
        if s @ y > 1e-12:
            moves = [*moves[-9:], (s, y)]
        ended = now - then < 1e-7 * max(1.0, now)
        w, now, slope = w + s, then, steeper
        if ended:
            break
    return w[:size].reshape(n_features, n_domains), prior + w[size:]


def fit(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, features_a_domain: int = FEATURES_A_DOMAIN) -> dict[str, list[float]]:
    """Weights for each domain of each feature of the model; the feature "" has the constants.

    The sample is taken of labelled rows by hash before the join, then of the joined rows by hash of id and
    text, so repeated ids change neither its bound nor its determinism."""
    known = labelled.select(F.col(id_col).alias("_id"), "domain").where(F.col("domain").isin(list(domains)) & F.col("_id").isNotNull())
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id", "domain").limit(sample_rows))
    joined = docs.select(id_col, F.col(text_col).alias("_text")).join(sample, F.col(id_col) == F.col("_id"))
    rows = shared.sampled(joined, sample_rows, "_id", "_text", "domain")
    described = shared.written(_describe(rows, "_text").select("domain", F.concat("_kinds", "_marks").alias("features")), "sample")
    counted = described.select("domain", F.explode("features").alias("feature")).groupBy("feature")
    counts = shared.written(counted.agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains))), "features")
    names = [f"n{k}" for k in range(len(domains))]
    total = counts.where(F.col("feature") == f"{_MARK}all").first()
    size = [total[n] if total else 0 for n in names]
    chosen: set[str] = set()
    for k, n in enumerate(names):
        rest = sum((F.col(m) for m in names if m != n), F.lit(0))
        inside, outside = F.col(n) / max(size[k], 1), rest / max(sum(size) - size[k], 1)
        pooled = (F.col(n) + rest) / max(sum(size), 1)
        parts = [(c, s) for share, total in ((inside, size[k]), (outside, sum(size) - size[k])) for c, s in ((total * share, share / pooled), (total * (1 - share), (1 - share) / (1 - pooled)))]
        g = 2 * sum((F.when(c > 0, c * F.log(s)).otherwise(0.0) for c, s in parts), F.lit(0.0))
        mark = F.col("feature").startswith(_MARK)
        some = counts.where((F.col("feature") != f"{_MARK}all") & (F.col(n) + rest >= LEAST_DOCUMENTS) & (F.col(n) + rest < max(sum(size), 1)))
        best = some.where((mark | (inside >= LEAST_LIFT * outside)) & (g >= LEAST_G)).orderBy(g.desc(), "feature").limit(features_a_domain)
        chosen |= {r.feature for r in best.select("feature").collect()}
    features = sorted(chosen)
    number = {f: k for k, f in enumerate(features)}
    place = {d: k for k, d in enumerate(domains)}
    has = F.array_intersect("features", F.array(*map(F.lit, features))) if features else F.array().cast("array<string>")
    seen = described.select("domain", has.alias("has")).collect()  # a short list for each row of the sample
    rows_of = [np.array([number[f] for f in r.has], np.int64) for r in seen]
    weights, constants = _fit_weights(rows_of, np.array([place[r.domain] for r in seen], np.int64), len(features), len(domains))
    shared.drop(counts)
    shared.drop(described)
    return {"": constants.tolist()} | {f: weights[k].tolist() for f, k in number.items()}


def _log_weight(model: dict[str, list[float]], features: list[str], k: int) -> Column:
    """Sum of domain k's weights of the features whose places are in the column _found."""
    if not features:
        return F.lit(model[""][k])
    weights = F.array(*(F.lit(model[f][k]) for f in features))
    return F.aggregate("_found", F.lit(model[""][k]), lambda acc, at: acc + F.get(weights, at - 1))


def posteriors(docs: DataFrame, model: dict[str, list[float]], *, text_col: str = "text") -> DataFrame:
    """``docs`` with _tokens, and _p: an array of the domains' posteriors."""
    features = sorted(f for f in model if f)
    df = _describe(docs, text_col)
    every = F.array(*map(F.lit, features))
    found = F.transform(F.array_intersect(F.concat("_kinds", "_marks"), every), lambda f: F.array_position(every, f)) if features else F.array().cast("array<bigint>")
    df = df.withColumn("_found", found).drop("_kinds", "_marks")
    for k in range(len(model[""])):
        df = df.withColumn(f"_l{k}", _log_weight(model, features, k))
    logs = [F.col(f"_l{k}") for k in range(len(model[""]))]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    df = df.withColumn("_top", top)
    for k in range(len(logs)):
        df = df.withColumn(f"_l{k}", F.exp(F.col(f"_l{k}") - F.col("_top")))
    total = sum(logs[1:], logs[0])
    # rounded, so that documents with the same evidence share a posterior
    shares = [F.round(x / total, 4) for x in logs[:-1]]
    last = F.greatest(1 - sum(shares, F.lit(0.0)), F.lit(0.0))
    return df.withColumn("_p", F.array(*shares, last)).drop("_found", "_top", *(f"_l{k}" for k in range(len(logs))))


def _rate(steps: list[list[float]], ahead: bool = False) -> Column:
    """The rate after the given rounds, from the column _p; ``ahead``: the point of the next gradient.

    A round takes the weights times the posteriors off the last point, cuts at 0, and goes on in the
    direction of the change by the momentum that stands last."""
    if not steps:
        return F.lit(1.0)
    rounds = F.expr(f"array({', '.join('array(' + ', '.join(f'{float(x)!r}D' for x in s) + ')' for s in steps)})")
    n = len(steps[0]) - 1

    def step(state: Column, r: Column) -> Column:
        x = F.greatest(F.lit(0.0), state["y"] - sum((F.col("_p")[k] * r[k] for k in range(n)), F.lit(0.0)))
        return F.struct(x.alias("x"), (x + r[n] * (x - state["x"])).alias("y"))

    start = F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    return F.aggregate(rounds, start, step, lambda state: state["y" if ahead else "x"])


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small positive semidefinite system with a little ridge, by elimination."""
    n = len(right)
    ridge = 1e-9 * (sum(matrix[k][k] for k in range(n)) or 1.0)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    for i in range(n):
        rows[i][i] += ridge
    for i in range(n):
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [x - f * y for x, y in zip(rows[j], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][k] * out[k] for k in range(i + 1, n))) / rows[i][i]
    return out


def _totals(tokens: list[float], weights: list[float]) -> list[float]:
    """Target tokens of each domain: the largest mixture of these weights that needs no domain more than once."""
    shares = [w / (sum(weights) or 1.0) for w in weights]
    whole = min((t / w for t, w in zip(tokens, shares) if w > 0), default=0.0)
    return [whole * w for w in shares]


def totals_without(members: DataFrame, unwanted: list[int]) -> list[float]:
    """Expected tokens of each domain in the documents of which none of the unwanted domains has over half.

    As a target this is where the others stay as they are: also those of which a vague posterior says that
    they hold a little of what is unwanted."""
    n = len(members.select("_p").first()[0]) if unwanted and not members.isEmpty() else 0
    clear = sum((F.col("_p")[k] for k in unwanted), F.lit(0.0)) <= 0.5
    got = members.where(clear).agg(*(F.sum(F.col("_tokens") * F.col("_p")[k]).alias(f"t{k}") for k in range(n))).first() if n else []
    return [x or 0.0 for x in got]


def bins(members: DataFrame) -> DataFrame:
    """_p and _tokens of documents that share a posterior, as a written table; rounds go over these."""
    return shared.written(members.groupBy("_p").agg(F.sum("_tokens").alias("_tokens")), "bins")


def fit_rates(members: DataFrame, weights: list[float], *, totals: list[float] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """What each round takes off a rate, as weights of the posteriors, with the momentum after it.

    Targets are ``totals``, or in proportion to the weights, as many as need no domain more than once. Residuals are weighed
    by the inverse of the domains' joint tokens M_jk = sum_d tokens_d p_dj p_dk, so that a round without
    rates at 0 would end the work.
    """
    n = len(weights)
    p = [F.col("_p")[k] for k in range(n)]
    expected = lambda x: [F.sum(F.col("_tokens") * p[k] * x) for k in range(n)]
    first = members.agg(*expected(F.lit(1.0)), *(F.sum(F.col("_tokens") * p[j] * p[k]) for j in range(n) for k in range(n))).first()
    tokens = [x or 0.0 for x in first[:n]]
    joint = [[first[n + n * j + k] or 0.0 for k in range(n)] for j in range(n)]
    if not sum(tokens):
        return []
    wanted = totals or _totals(tokens, weights)
    steps: list[list[float]] = []
    now, pace, least, since = tokens, 1.0, math.inf, 0
    for _ in range(rounds):
        apart = [(x or 0.0) - t for x, t in zip(now, wanted)]
        worst = max(map(abs, apart))
        least, since = (worst, 0) if worst < 0.99 * least else (least, since + 1)
        if worst < tolerance * sum(tokens) or since == STALL:
            break
        heavier = (1 + math.sqrt(1 + 4 * pace**2)) / 2
        steps.append([*_solve(joint, apart), (pace - 1) / heavier])
        pace = heavier
        now = members.withColumn("_x", _rate(steps, ahead=True)).agg(*expected(F.col("_x"))).first()
    return steps


def residual(members: DataFrame, weights: list[float], steps: list[list[float]]) -> float:
    """The largest deviation of a domain's expected tokens from its target, as a share of all tokens."""
    n = len(weights)
    mass = [F.col("_tokens") * F.col("_p")[k] for k in range(n)]
    got = members.withColumn("_x", _rate(steps)).agg(*(F.sum(m) for m in mass), *(F.sum(m * F.col("_x")) for m in mass)).first()
    tokens, mixed = [x or 0.0 for x in got[:n]], [x or 0.0 for x in got[n:]]
    return max(abs(m - t) for m, t in zip(mixed, _totals(tokens, weights))) / sum(tokens) if sum(tokens) else 0.0


def _mean_rate(members: DataFrame, steps: list[list[float]], wanted: list[int]) -> float:
    """Mean rate of the expected tokens of the wanted domains; 1 where they get none."""
    share = sum((F.col("_p")[k] for k in wanted), F.lit(0.0)) * F.col("_tokens")
    got, all_tokens = members.withColumn("_x", _rate(steps)).agg(F.sum(share * F.col("_x")), F.sum(share)).first()
    return got / all_tokens if got and all_tokens else 1.0


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, **how) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and residual for every row of ``docs``.

    ``residual``: the largest deviation of a domain's expected tokens from its target, as a share of all tokens."""
    domains = sorted(targets)
    model = fit(docs, labelled, domains, id_col=id_col, text_col=text_col, **how)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    members = shared.written(posteriors(rows, model, text_col="_text").select("doc_id", "_tokens", "_p"), "members")
    few = bins(members)
    steps = fit_rates(few, [targets[d] for d in domains], rounds=rounds)
    shown = [F.col("_p")[k].alias(f"p_{d}") for k, d in enumerate(domains)]
    apart = F.lit(residual(few, [targets[d] for d in domains], steps)).alias("residual")
    return members.select("doc_id", F.col("_tokens").cast("long").alias("n_tokens"), *shown, _rate(steps).alias("rate"), apart)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", nearest: bool = False, rounds: int = ROUNDS, **how) -> DataFrame:
    """The rows of ``docs`` as often as their rates say, all columns unchanged.

    A rate's fraction becomes a whole copy by a hash of the row, or with ``nearest`` by rounding the rate
    in relation to the mean rate of the wanted domains' tokens; then a domain of weight 0 has as its target
    what documents that are not mostly of it hold of it (:func:`totals_without`), so those are left alone.
    """
    domains = sorted(targets)
    model = fit(docs, labelled, domains, id_col=id_col, text_col=text_col, **how)
    names = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(text_col).alias("_text"))
    # written once: the rounds read two columns of it, the result the rows
    members = shared.written(posteriors(inner, model, text_col="_text").select("_row", "_tokens", "_p"), "members")
    small = bins(members)
    unwanted = [k for k, d in enumerate(domains) if targets[d] == 0]
    totals = totals_without(small, unwanted) if nearest and unwanted else None
    steps = fit_rates(small, [targets[d] for d in domains], totals=totals, rounds=rounds)
    scale = _mean_rate(small, steps, [k for k, d in enumerate(domains) if targets[d] > 0]) if nearest else 1.0
    part = F.lit(0.5) if nearest else F.pmod(F.xxhash64(F.col("_row")[id_col], F.col("_row")[text_col]), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(_rate(steps) / scale + part).cast("int")
    many = members.select("_row", copies.alias("_n")).where("_n > 0").select(F.explode(F.array_repeat("_row", F.col("_n"))).alias("_row"))
    return many.select(*(F.col("_row")[c].alias(c) for c in names))


def op7_mixing_to_target_weights(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, posteriors over the label domains and rate of every document."""
    labelled = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled, MIX_TARGETS)
