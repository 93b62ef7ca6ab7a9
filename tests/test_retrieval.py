"""Golden values and hand-made vectors of the retrieval engine."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dictionaries as D
from tidemark.functions import text as T
from tidemark.operators import metrics as M
from tidemark.operators import retrieve as R
from tidemark.operators import score as S
from tidemark.operators import vendor as V
from tidemark.sources import readers, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit(" A b\ta \n"))) == ["a", "b"]
    assert one(spark, T.tokens(F.lit(""))) == [] and one(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, T.overlap_substrings(F.array(F.lit("fix"), F.lit("no")), F.lit("prefix"))) == 1
    assert one(spark, T.long_terms(F.lit("What, broken?! now"))) == ["what", "broken"]
    assert one(spark, T.clamp(F.lit("1.7"))) == 1.0 and one(spark, T.clamp(F.lit("x"))) == 0.0
    assert one(spark, T.first_json(F.lit('```json\n{"a": 2}\n``` ok'), "a int")).a == 2
    assert set(one(spark, T.expand_synonyms(F.array(F.lit("kernel")), D.SYNONYMS))) == set(D.SYNONYMS["linux"])


def test_substring_hits_without_pairs_of_texts_and_questions(spark, monkeypatch):
    texts = [(1, "The prefix is fixed\tnow"), (1, "the prefix is fixed\tnow"), (2, None), (3, ""), (None, "ÉTÉ à l'été"), (4, "x" * 5000 + "needle" + "y" * 5000), (5, "a b  c\x0bd\x85e\u00a0f"), (6, "aa aaa"), (7, "never here")]
    asked = [(1, ["fix", "pre", "e", "fix"]), (1, ["needle", "xxn", "n"]), (2, ["é", "été", "t"]), (3, ["a b", "  ", "", "b"]), (4, [None, "\x85e", "\u00a0f", "d"]), (None, ["aaa", "aa", "a"]), (5, []), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, terms array<string>")
    for block, pairs in ((4 << 20, 1 << 20), (64, 5)):  # at once; a few questions and texts at a time
        if hasattr(R, "PAIRS"):
            monkeypatch.setattr(R, "SEARCH_BYTES", block)
            monkeypatch.setattr(R, "PAIRS", pairs)
        for least in (1, 2):
            want = [(q, d, n) for q, terms in asked for d, text in texts if text is not None and (n := sum(t is not None and t in text.lower() for t in terms or ())) >= least]
            got = R.substring_hits(queries, docs, least)
            assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert R.substring_hits(queries.limit(0), docs).count() == 0 == R.substring_hits(queries, docs.limit(0)).count()


def test_rewrite_cascades(spark):
    got = one(spark, T.rewrite(F.lit("Latest Grafana release notes"), D.EXPANSIONS))
    assert got.startswith("latest version release release notes changelog version")


def test_dates(spark):
    cases = {"bug since yesterday": "20260412", "I know": "20260413", "june 3rd, 2025": "20250603", "march 2024": "20240301", "on 2026-01-05": "20260105", "build 20240229": "20240229", "no date": None}
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", V.extract_date(F.col("q"), date(2026, 4, 13)).alias("d"))
    assert {r.q: r.d for r in df.collect()} == cases


def test_vendor_ladder(spark):
    registry = spark.createDataFrame([("grafana", 3), ("obscure", 4)], "vendor string, stage int")
    cases = {"home assistant on ubuntu": "homeassistant", "Sonoff switch": "firefox", "windows or mac": "windows", "the grafana panel": "grafana", "an obscure tool": "obscure", "g6 zoom": "Ubiquiti", "[r/selfhosted] help": "linux", "none": None}
    q = spark.createDataFrame(list(enumerate(cases)), "query_id long, query string")
    got = {r.query_id: r.vendor for r in V.extract_vendor(q, registry).collect()}
    assert [got.get(k) for k in range(len(cases))] == list(cases.values())


def test_fuzzy_ratio(spark):
    words = spark.createDataFrame([("kubernetess",), ("kubernet",)], "word string")
    names = spark.createDataFrame([("kubernetes",), ("docker",)], "vendor string")
    assert [(r.word, r.vendor) for r in V.fuzzy_vendor(words, names).collect()] == [("kubernetess", "kubernetes")]


def metric(spark, ranking, grades, ks=(1, 3)):
    r = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(ranking)], "query_id long, doc_id string, rank int")
    g = spark.createDataFrame([(1, d, v) for d, v in grades.items()], "query_id long, doc_id string, grade int")
    return M.ir_metrics(r, g, spark.createDataFrame([(1,)], "query_id long"), ks=ks).first()


def test_metric_vectors(spark):
    perfect = metric(spark, ["a", "b", "c"], {"a": 2, "b": 1, "c": 0})
    assert perfect.ndcg_3 == pytest.approx(1) and perfect.mrr == 1 and perfect.precision_3 == pytest.approx(2 / 3)
    turned = metric(spark, ["c", "b", "a"], {"a": 2, "b": 1, "c": 0})
    assert turned.mrr == 0.5 and turned.ndcg_3 == pytest.approx((1 / math.log2(3) + 3 / 2) / (3 + 1 / math.log2(3)))
    twice = metric(spark, ["c", "c", "a"], {"a": 2, "c": 0})
    assert twice.mrr == 0.5
    assert metric(spark, ["a"], {"a": 0}).recall_1 == 0
    assert metric(spark, ["a"], {"a": 1}).precision_3 == pytest.approx(1 / 3)
    assert metric(spark, [], {"a": 1}).mrr is None


# A recorded run (category, baseline, pipeline) and its published summary.
RECORDED = [
    ("security", 0.75, 0.85), ("security", 0.7, 0.75), ("security", 0.8, 0.85), ("security", 0.8, 0.85), ("security", 0.8, 0.85), ("bugs", 0.758, 0.85), ("bugs", 0.8, 0.85), ("bugs", 0.8, 0.85),
    ("releases", 0.7, 0.75), ("releases", 0.7, 0.67), ("releases", 0.75, 0.8), ("community", 0.8, 0.85), ("community", 0.75, 0.85), ("community", 0.67, 0.8), ("general", 0.75, 0.85),
]
RECORDED_MEANS = {"security": (0.77, 0.83), "bugs": (0.786, 0.85), "releases": (0.717, 0.74), "community": (0.74, 0.833), "general": (0.75, 0.85)}


def test_recorded_run(spark):
    df = spark.createDataFrame([(k + 1, *r) for k, r in enumerate(RECORDED)], "n int, category string, b double, t double")
    every = M.paired(df, "b", "t").first()
    assert (round(every.mean_baseline, 3), round(every.mean_treated, 3), round(every.improvement_pct, 1)) == (0.755, 0.818, 8.3)
    by = {r.category: (round(r.mean_baseline, 3), round(r.mean_treated, 3)) for r in M.paired(df, "b", "t", ("category",)).collect()}
    assert by == RECORDED_MEANS
    assert round(M.tertile_gain(df, "n", "t", 15).first().gain_pct, 1) == 0.0


def test_dataset_hash():
    # The ten questions of the recorded run, and its hash.
    questions = [
        "G6 Bullet unstable?",
        "GGUF in latest versions? How to actually install nodes etc in latest versions?",
        "Updated to kernel 6.19.11 and now desktop doesnt load. Selected the previous version from grub menu and it works now. Should I just wait for the next version and will it fix it? Below is what i got from journalctl",
        "Updated to kernel 6.19.11 and now desktop doesnt load. Selected the previous version from grub menu and it works now. Should I just wait for the next version and will it fix it? Below is what i got from journalctl",
        "I can't run Ace-Step 1.5 XL on Comfy!?",
        "Ollama local model connection broken?",
        "if you're trying to run gemma 4 with openclaw and everything is broken, here's every bug and workaround i've found",
        "What to do if phone lost forever, icloud password forgotten, email IS icloud",
        "Queue limitations - is there a hard limit of 200 - even when I set it higher",
        "Was a homeassistant mistake ??",
    ]
    assert sinks.dataset_hash(questions) == "237950e265eb"
    assert sinks.dataset_hash(["a", "b"]) != sinks.dataset_hash(["b", "a"])


def test_intervals(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (3.0,)], "v double")
    r = df.agg(*M.mean_ci(F.col("v"))).first()
    assert (r["mean"], r["n"]) == (2.0, 3) and r["ci95"] == pytest.approx(1.96 / math.sqrt(3))
    assert df.where("v = 1").agg(*M.mean_ci(F.col("v"))).first()["ci95"] == 0


def test_exactness(spark):
    cases = [(True, True, True, 1.0), (False, True, True, 0.6), (False, True, False, 0.35), (False, False, False, 0.1)]
    df = spark.createDataFrame([c[:3] for c in cases], "a boolean, b boolean, c boolean")
    assert [r.q for r in df.select(S.exactness(F.col("a"), F.col("b"), F.col("c")).alias("q")).collect()] == [c[3] for c in cases]


def test_memory_does_not_depend_on_partitions(spark):
    rows = [(k, "fix it", f"fix it quickly please word{chr(97 + k % 3)}", 0.1 * (k % 7)) for k in range(30)]
    df = spark.createDataFrame(rows, "seq long, q string, r string, quality double")
    seen = [sorted((r.seq, r.term, round(r.score, 9)) for r in S.memory_scores(S.memory_deltas(df.repartition(n), "seq", F.col("q"), F.col("r"), F.col("quality")), "seq").collect()) for n in (1, 6)]
    assert seen[0] == seen[1] and len({t for _, t, _ in seen[0]}) == 5


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"linux": [{"versionSearchTags": ["linux", "security"], "versionProductName": "kernel", "versionNumber": "6.1", "versionReleaseNotes": ["a patch", "b"], "classification": {"securityType": ["SECURITY"]}}, {"versionProductName": "other", "versionReleaseNotes": "text"}]}')
    rows = readers.releases(spark, str(tmp_path / "r.json"))
    assert sorted((r.vendor, r.versionReleaseNotes) for r in rows.collect()) == [("linux", "a patch b"), ("linux", "text")]
    docs = readers.release_documents(rows, F.array(F.lit("linux"), F.lit("patch"))).collect()
    assert [(d.title, d.sentiment, d.hits) for d in docs] == [("kernel 6.1", "Negative", 2)]
    feed = spark.createDataFrame([("<rss><channel><item><title>T</title><link>u</link><pubDate>d</pubDate></item></channel></rss>",)], "value string")
    assert [tuple(r)[:3] for r in readers.feed_items(feed).collect()] == [("T", "u", "d")]
    q = spark.createDataFrame([("1", None, " why ", None, None, "", "g"), ("2", None, None, " ", None, None, None)], readers.QUESTION)
    assert [(r.query, r.ground_truth) for r in readers.questions(q).collect()] == [("why", "g")]


def test_upsert_and_report(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, g int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, g int")
    sinks.upsert(spark, None, old, ["k"], str(tmp_path / "1"))
    sinks.upsert(spark, str(tmp_path / "1"), new, ["k"], str(tmp_path / "2"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "2")).collect()) == [("a", 1), ("b", 2), ("c", 2)]
    cells = spark.createDataFrame([("s", "mrr", 0.5, 0.1, 3), ("s", "ndcg", None, None, 0)], "system string, metric string, mean double, ci95 double, n long")
    assert sinks.report(cells).first().line == "| s | 0.500 ± 0.100 |  |"


def test_order_over_ranges(spark):
    from tidemark.operators import order

    rows = [((k * 7919) % 1000, k % 5) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    total, want = 0, {}
    for n, (i, v) in enumerate(sorted(rows), 1):
        total += v
        want[i] = (n, total)
    got = {r.id: r.seq for r in order.numbered(df, "id", ranges=9).collect()}
    sums = {r.id: r.s for r in order.running_sum(df, "id", F.col("v"), "s", ranges=9).collect()}
    assert {i: (got[i], sums[i]) for i in got} == want
    assert order.numbered(df.limit(0), "id").count() == 0


def test_question_blocks(spark):
    from tidemark.operators import retrieve as R

    rows, asked = spark.range(20).toDF("a"), spark.range(50).select(F.col("id").alias("query_id"), F.lit("x" * 100).alias("t"))
    assert R.against(rows, asked, most=1000).count() == 1000
    assert R.against(rows, asked, F.col("a") == F.col("query_id"), most=1000).count() == 20


def test_stream_with_late_rows(spark, tmp_path):
    from tidemark.streaming import memory

    schema = "query_id long, query string, rewritten string, quality double, ts timestamp"
    rows = lambda hour, n: spark.createDataFrame([(k, "fix", "fix patch", 0.5, f"2026-01-01 {hour:02d}:00:00") for k in range(n)], "query_id long, query string, rewritten string, quality double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, (hour, n) in enumerate([(5, 2), (9, 3), (10, 1), (4, 7)]):  # the last file is later than the watermark allows
        rows(hour, n).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    query = memory.term_scores(stream, late="1 hour").writeStream.outputMode("append").format("memory").queryName("late_terms").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.term, r.uses) for r in spark.table("late_terms").collect()} <= {("patch", 2), ("patch", 3), ("patch", 1)}
    batches = memory.start(stream, str(tmp_path / "c2"), str(tmp_path / "parts"))
    batches.awaitTermination()
    assert [(r.term, r.uses, round(r.score, 9)) for r in memory.current(spark, str(tmp_path / "parts")).collect()] == [("patch", 13, 2.6)]
