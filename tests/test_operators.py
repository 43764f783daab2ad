"""Curation, evaluation, telemetry, feedback, sources and streams on small fixtures."""

import json

from pyspark.sql import functions as F

from textwarden.operators import curate as C
from textwarden.operators import evaluate as E
from textwarden.operators import feedback as B
from textwarden.operators import telemetry as T
from textwarden.sources import readers as R
from textwarden.sources import writers as W
from textwarden.streaming import stateful as S


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(1, " A b "), (2, "a B"), (3, ""), (4, None), (5, "c")], "i int, text string")
    assert sorted(r.i for r in C.dedupe(df, C.normalized_key(F.col("text")), ["i"]).collect()) == [1, 5]


def test_split_shares_are_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("string").alias("g"))
    n = {(r.g, r.split): r.n for r in C.split_positions(df, "k", ["g"]).groupBy("g", "split").agg(F.count("*").alias("n")).collect()}
    assert n[("true", "train")] == int(334 * 0.8) and n[("false", "train")] == int(666 * 0.8) and sum(n.values()) == 1000
    null = spark.createDataFrame([(i, None) for i in range(10)], "k long, g string")
    assert C.split_positions(null, "k", ["g"]).count() == 10


def test_upper_median_and_stats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 7)], "g string, v int")
    assert {r.g: r.median for r in C.upper_median(df, "g", F.col("v")).collect()} == {"a": 3, "b": 7}


def test_relabel_and_categories(spark):
    df = spark.createDataFrame([("you stupid idiot shut up", "safe"), ("calm", "safe"), ("i will kill and shoot", "toxic"), (None, "toxic")], "t string, l string")
    r = df.select(C.relabel_second(F.col("t"), F.col("l")).alias("r"), C.categorize(F.col("t"), F.col("l")).alias("c")).collect()
    assert [x.r for x in r] == ["directed_toxic", None, None, None] and [x.c for x in r] == ["safe", "safe", "violence", "harassment"]


def test_undersample_and_generate(spark):
    df = spark.createDataFrame([(i, "toxic" if i < 4 else "safe") for i in range(40)], "k long, label string")
    assert C.undersample(df, "label", 1.5, "k").groupBy("label").count().where("label = 'safe'").collect()[0]["count"] == 6
    t, w = spark.createDataFrame([("a {} b",)], "template string"), spark.createDataFrame([("x",), ("y",)], "term string")
    assert sorted(r.text for r in C.generate(t, w).collect()) == ["a x b", "a y b"]


def test_metrics_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (None, 1)], "y int, p int")
    m = E.metrics(E.confusion(df, F.col("y"), F.col("p"))).collect()[0]
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5, 0.5)
    m = E.metrics(E.confusion(df.limit(0), F.col("y"), F.col("p"))).collect()[0]
    assert m.f1 == 0.0
    s = E.sweep(spark.createDataFrame([(1, 0.9), (0, 0.4), (1, 0.3)], "y int, s double"), F.col("y"), F.col("s"), [0.2, 0.5])
    assert E.best_recall(s).collect()[0].threshold == 0.2
    assert E.best_balanced(s, 0.99, 0.99, 0.5).collect()[0].threshold == 0.5


def test_majority_ties_by_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "item int, vote string, o int")
    r = C.majority(df, "item", "vote", "o").collect()[0]
    assert r.winner == "b" and r.agreement == 0.5


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double")
    h = T.histogram(df, F.col("v"), (50.0, 100.0))
    assert {r.le: r.n for r in h.collect()} == {50.0: 50, 100.0: 100, float("inf"): 100}
    assert T.histogram_quantile(h, 0.75).collect()[0].value == 75.0


def test_feedback_cycle(spark):
    cols = "feedback_id string, tenant_id string, request_id string, feedback_type string, comment string, reviewed boolean, approved boolean, included_in_training boolean, reviewed_by string, reviewed_at timestamp, trained_at timestamp, corrected_category string"
    f = spark.createDataFrame([("f1", "t", "r1", "False Negative", "You Are (bad)", True, True, False, None, None, None, "x"), ("f2", None, "r2", "correct", None, False, None, None, None, None, None, None)], cols)
    p = B.learned(f).collect()
    assert [(r.pattern, r.source_feedback) for r in p] == [(r"(?i)\byou\s+are\s+\(bad\)\b", "f1")]
    s = B.stats(f).collect()[0]
    assert s.total == 2 and s.by_type == {"false_negative": 1, "correct": 1} and s.pending == 1
    dec = spark.createDataFrame([("f2", True, "me", None)], "feedback_id string, approve boolean, reviewer string, at timestamp")
    assert {r.feedback_id: r.approved for r in B.review(f, dec).collect()} == {"f1": True, "f2": True}
    assert B.stats(f.limit(0)).collect()[0].total is None


def test_sources_and_sinks(spark, tmp_path):
    a = tmp_path / "in"
    a.mkdir()
    (a / "hate.jsonl").write_text('{"text": "x", "label": "toxic"}\nnot json\n')
    (a / "router.jsonl").write_text('{"text": "y", "label": "safe"}\n')
    assert [(r.text, r.category) for r in R.jsonl_dir(spark, str(a)).collect()] == [("x", "hate")]
    assert R.jsonl_optional(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "d.json").write_text(json.dumps({"patterns": [{"pattern": "p", "name": "n"}], "metadata": {"total_patterns": 1}}, indent=1))
    assert R.json_document(spark, str(tmp_path / "d.json")).collect()[0].patterns[0].pattern == "p"
    (tmp_path / "a.csv").write_text("Tweet,class\nhi,1\n")
    (tmp_path / "b.csv").write_text("text,label\nho,0\n")
    assert sorted(tuple(r) for r in R.heterogeneous(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()) == [("hi", "1"), ("ho", "0")]
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("z", "b")], "text string, category string")
    out = str(tmp_path / "out")
    W.append_new(df, out)
    W.append_new(df, out)
    assert spark.read.json(out).count() == 2
    W.by_category(df, str(tmp_path / "cat"))
    assert spark.read.json(str(tmp_path / "cat")).where("category = 'a'").count() == 2
    cur = spark.createDataFrame([("k", 1, "old")], "key string, t int, v string")
    new = spark.createDataFrame([("k", 2, "new"), ("l", 1, "x")], "key string, t int, v string")
    assert {r.key: r.v for r in W.upsert(cur, new, "key", "t").collect()} == {"k": "new", "l": "x"}


def test_nested_sources(spark):
    body = json.dumps({"p1": {"post_tokens": ["a", "b"], "annotators": [{"label": "hate", "target": ["x"]}, {"label": "normal", "target": []}]}})
    assert [(r.text, r.annotator, r.label) for r in R.annotations(spark.createDataFrame([(body,)], "body string")).collect()] == [("a b", 0, "hate"), ("a b", 1, "normal")]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id int, parent int")
    assert sorted((r.id, r.depth) for r in R.replies(spark, tree).collect()) == [(1, 0), (2, 1), (3, 2)]
    lines = spark.createDataFrame([("# HELP x",), ('x_total{a="b",c="d"} 4',), ("y 1.5",), ("bad line here",)], "value string")
    assert [(r.metric, r.labels, r.value) for r in R.metrics_text(lines).collect() if r.value is not None] == [("x_total", {"a": "b", "c": "d"}, 4.0), ("y", {}, 1.5)]


def test_state_steps():
    log, ok, left = S.limit_step([0.0], 1.0, 1, 60)
    assert not ok and log == [0.0]
    s = ("closed", 0, 0, 0.0)
    for t in range(5):
        s, a = S.breaker_step(s, t, False)
    assert s[0] == "open" and S.breaker_step(s, 10, True)[1] is False
    s, a = S.breaker_step(s, 40, True)
    assert s[0] == "half_open" and a
    for t in (41, 42):
        s, a = S.breaker_step(s, t, True)
    assert s[0] == "closed"
    b = ([], 0, 0.0)
    calls = []
    for t in range(4):
        b, ok = S.budget_step(b, t, 2, 10)
        calls.append(ok)
    assert calls == [True, True, False, False]


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"c{i % 3}", f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, client string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    want = sorted((r.client, r.ts, r.allowed) for r in S.limiter_batch(df).collect())
    got = S.run_to_end(S.limiter_stream(S.events(spark, str(tmp_path / "e"), df.schema)), "limiter_test")
    assert sorted((r.client, r.ts, r.allowed) for r in got.collect()) == want


def clicks(spark, n=120, clients=3):
    rows = [(i, f"c{i * i % clients}", f"2024-01-{1 + i // 40:02d} {i % 24:02d}:{i % 60:02d}:{i % 7:02d}", i % 3 > 0) for i in range(n)] + [(n, None, "2024-01-01 00:00:00", True), (n + 1, "c0", None, True)]
    return spark.createDataFrame(rows, "event_id long, client string, ts string, ok boolean").withColumn("ts", F.to_timestamp("ts"))


def test_state_goes_from_range_to_range(spark):
    df = clicks(spark, 60)
    for run in (S.limiter_batch, S.budget_batch):
        want = sorted(map(tuple, run(df.select("event_id", "client", "ts")).collect()))
        assert len(want) == 60 and sorted(map(tuple, run(df.select("event_id", "client", "ts"), most=9).collect())) == want
    want = sorted(map(tuple, S.breaker_batch(df).collect()))
    assert sorted(map(tuple, S.breaker_batch(df, most=12).collect())) == want
    assert S.limiter_batch(df.select("event_id", "client", "ts").limit(0)).count() == 0
    edges = S._edges(df.where("client is not null and ts is not null"), 10)
    assert len(edges) > 3 and edges == sorted(set(edges))


def test_breaker_and_budget_streams_equal_batch(spark, tmp_path):
    df = clicks(spark).where("client is not null and ts is not null")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = S.run_to_end(S.breaker_stream(S.events(spark, str(tmp_path / "e"), df.schema)), "breaker_test").select("client", "ts", "ok", "admitted", "state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.breaker_batch(df).collect()))
    got = S.run_to_end(S.budget_stream(S.events(spark, str(tmp_path / "e"), df.schema)), "budget_test").select("client", "ts", "called")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.budget_batch(df).collect()))


def test_refreshed_statistics(spark, tmp_path):
    df = clicks(spark, 30).where("ts is not null")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    run = S.refreshed(S.events(spark, str(tmp_path / "e"), df.schema).groupBy("ok").count(), "refreshed_test", "1 second")
    try:
        run.processAllAvailable()
        assert sum(r["count"] for r in spark.table("refreshed_test").collect()) == 31
    finally:
        run.stop()


def test_gates_of_the_judge():
    said = []

    def answer(prompt):
        said.append(prompt)
        if "fail" in prompt:
            raise ValueError("no")
        return "CLASSIFICATION: safe"

    def run(rows, **more):
        state, out = None, []
        for t, p in rows:
            state, (status, _) = S.gated_step(state, t, p, answer, more.get("rpm", 30), more.get("daily", 10.0), lambda p, a: 1.0, 2, 30.0, 1, more.get("retries", 1))
            out.append(status)
        return out

    assert run([(0, "a"), (1, "a"), (2, "a"), (70, "a")], rpm=2) == ["called", "called", "rate_limited", "called"]
    assert run([(0, "a"), (100, "a"), (200, "a"), (90_000, "a")], daily=2.0) == ["called", "called", "cost_cap", "called"]
    assert run([(0, "fail"), (1, "fail"), (2, "a"), (40, "a"), (41, "a")]) == ["failed", "failed", "breaker_open", "called", "called"]
    said.clear()
    assert run([(0, "fail")], retries=3) == ["failed"] and len(said) == 3
    assert [S.backoff(i) for i in (0, 1, 2, 9)] == [1.0, 2.0, 4.0, 60.0] and S.backoff(0, jitter=0.5) == 1.5


def test_percentiles_gauges_and_positions(spark):
    rows = [("a", float(v)) for v in (5, 5, 5, 1, 9, 2.5, 7.25)] + [("b", 3.0), ("c", None), (None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p90, r.n) for r in T.percentiles(df, "g", "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (5.0, 9.0, 7), "b": (3.0, 3.0, 1), None: (4.0, 6.0, 2)}
    assert T.percentiles(df.limit(0), "g", "v", {"p": 0.5}).count() == 0
    e = clicks(spark, 60).where("ts is not null")
    got = {r.event_id: r.in_flight for r in T.running(e, ["client"], "ts", ["ts", "event_id"], F.lit(1), seconds=60).collect()}
    by: dict = {}
    for r in sorted(e.collect(), key=lambda r: (r.ts, r.event_id)):
        by[r.client] = by.get(r.client, 0) + 1
        assert got[r.event_id] == by[r.client]
    at = C.positions(spark.range(1000).withColumnRenamed("id", "k"), F.floor(F.col("k") / 7), ["k"])
    assert at.where("_pos <> k").count() == 0
    one = C.undersample(spark.createDataFrame([(1, "safe"), (2, None)], "k long, label string"), "label", 1.5, "k")
    assert one.count() == 0


def test_model_errors_are_noted_and_unsure_rows_are_judged(spark):
    from textwarden.operators import scorer as M
    from textwarden.operators.decide import analyze

    def broken(texts):
        raise RuntimeError("no model")

    def model(texts):
        return [("harassment", 0.65 if "maybe" in t else 0.95 if "surely" in t else 0.1) for t in texts]

    rows = [(1, "surely this is a longer text"), (2, "maybe this is a longer text"), (3, "nothing to see in this text"), (4, None), (5, ""), (6, "maybe write to a.b@mailbox.example")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.toxicity_source, r.action, r.score_error) for r in analyze(df, scorer=M.model_scorer(broken)).collect()}
    assert got[1][2].startswith("RuntimeError") and got[4] == ("none", "allow", None) and got[6][1] == "redact"
    yes = M.judge(lambda ps: ["CLASSIFICATION: threat\nCONFIDENCE: low\nREASON: x" for _ in ps])
    got = {r.doc_id: (r.toxicity_source, r.action) for r in analyze(df, scorer=M.model_scorer(model), judge=yes).collect()}
    assert got == {1: ("model", "block"), 2: ("judge", "block"), 3: ("none", "allow"), 4: ("none", "allow"), 5: ("none", "allow"), 6: ("none", "redact")}
    no = M.judge(lambda ps: ["CLASSIFICATION: safe" for _ in ps])
    assert analyze(df, scorer=M.model_scorer(model), judge=no).where("doc_id = 2 and action = 'allow'").count() == 1
    plan = analyze(df, scorer=M.model_scorer(model)).where("action = 'block'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[KEYWORD]") == analyze(df)._jdf.queryExecution().optimizedPlan().toString().count("[KEYWORD]") > 0


def test_named_files_documents_and_ids(spark, tmp_path):
    df = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", None)], "text string, category string")
    W.named_jsonl(df, str(tmp_path / "n"))
    assert sorted(p.name for p in (tmp_path / "n").iterdir() if p.suffix == ".jsonl") == ["a.jsonl", "b.jsonl"]
    W.json_document(df.select(F.col("text").alias("pattern")), str(tmp_path / "d"), "2025-01-01")
    assert R.json_document(spark, str(tmp_path / "d")).collect()[0].metadata.total_patterns == 3
    f = spark.createDataFrame([("0e10e3ae-7062-4771-a0c9-c73394514bec", "correct", None), ("abc-12345678", "correct", None), (None, "correct", None)], "request_id string, feedback_type string, comment string")
    assert [r.reject for r in B.valid(f).collect()] == [None, "request_id", "request_id"]


def test_every_injection_and_finance_rule_has_evidence():
    import re

    from textwarden.plans.evidence import TEXTS
    from textwarden.rules.packs import FINANCE, INJECTION

    assert all(any(re.search(r.pattern, t) for t in TEXTS) for r in (*INJECTION, *FINANCE))


def test_entry_runs_and_sql_belongs_to_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 1
