import json

import pytest
from pyspark.sql import functions as F

from panelmark.functions import text as tx
from panelmark.jobs import loop
from panelmark.operators import history, metrics, pairs, resample, votes
from panelmark.sources import tables
from panelmark.streaming import intake


def ratings(spark, patterns):
    """patterns: (domain, labels, times)."""
    rows, item = [], 0
    for domain, labels, times in patterns:
        for _ in range(times):
            rows += [(domain, item, f"r{i}", label) for i, label in enumerate(labels)]
            item += 1
    return spark.createDataFrame(rows, "domain string, item_id long, rater_id string, label string")


def test_panel_metrics_of_known_patterns(spark):
    df = ratings(spark, [("g", ["HIGH"] * 3, 18), ("g", ["HIGH", "HIGH", "LOW"], 2), ("one", ["LOW"] * 3, 4)])
    got = {r.domain: r for r in metrics.panel_metrics(df).collect()}
    g = got["g"]
    assert [round(x, 4) for x in (g.weighted, g.all_agree, g.pairwise, g.fleiss_kappa, g.gwet_ac1)] == [0.9667, 0.9, 0.9333, -0.0345, 0.9287]
    assert got["one"].fleiss_kappa is None and got["one"].gwet_ac1 == 1.0


def test_nominal_ac1_is_null_with_one_category(spark):
    df = ratings(spark, [("a", ["HIGH"] * 3, 2), ("b", ["HIGH", "LOW"], 1), ("b", ["LOW"], 1)])
    got = {r.domain: r for r in metrics.gwet_ac1_nominal(df).collect()}
    assert got["a"].ac1 is None and got["b"].n_items == 1 and got["b"].ac1 == pytest.approx(-1.0)


def test_majority_rules_differ(spark):
    df = ratings(spark, [("d", ["HIGH", None, None], 1), ("d", ["HIGH", "LOW"], 1)])
    assert [r.label for r in votes.majority(df, "abs2").orderBy("item_id").collect()] == ["LOW", "LOW"]
    assert [r.label for r in votes.majority(df, "plurality_tie_low").orderBy("item_id").collect()] == ["HIGH", "LOW"]
    assert [r.label for r in votes.majority(df, "plurality_first").orderBy("item_id").collect()] == ["HIGH", "HIGH"]


def test_percentiles_and_floor():
    assert resample.percentile_places(10_000, "count") == (250, 9749)
    assert resample.percentile_places(8761, "span") == (219, 8541)
    assert metrics.metric_floor(3, 2, 0.8, 20) == (pytest.approx(2 / 3), 8)
    assert [round(metrics.metric_floor(k, 2, 0.8, 20)[0], 3) for k in (2, 3, 4, 5)] == [0.5, 0.667, 0.5, 0.6]


def test_bootstrap_drops_undefined_draws(spark):
    df = ratings(spark, [("g", ["HIGH"] * 3, 18), ("g", ["HIGH", "HIGH", "LOW"], 2)])
    r = resample.bootstrap_ac1_ci(df).first()
    assert r.value == pytest.approx(0.9287, abs=1e-4) and abs(r.kept - 8780) < 150
    assert r.low == pytest.approx(0.8033, abs=0.01) and r.high == pytest.approx(0.9655, abs=0.01)


def test_history_flags(spark):
    h = spark.createDataFrame([("c", i, w, 0.1) for i, w in enumerate([0.684, 0.7, 0.684, 0.85, 0.7], 1)], "domain string, iteration int, weighted double, all_agree double")
    assert [r.stagnated for r in history.stagnation_flag(h).orderBy("iteration").collect()] == [False, False, True, False, False]
    assert [r.regressed for r in history.regression_flag(h).orderBy("iteration").collect()] == [False] * 4 + [True]
    assert history.best_iteration(h).first().iteration == 4
    s = history.calibration_summary(h).first()
    assert s.weighted_history == [0.684, 0.7, 0.684, 0.85, 0.7] and (s.final_version, s.best_version) == ("4", "3")


def test_json_repairs_and_revision(spark):
    good = {"updated_HIGH": ["a"], "updated_LOW": ["b"], "updated_conflict_rule": "c"}
    cases = ["```json\n" + json.dumps(good) + "\n```", json.dumps(good) + " tail", "head " + json.dumps(good) + " tail", "no json", json.dumps({"updated_HIGH": []})]
    df = spark.createDataFrame([(i, c, "0", "ctx", ["h"], ["l"], "r") for i, c in enumerate(cases)], "i int, response string, version string, domain_context string, HIGH array<string>, LOW array<string>, conflict_rule string")
    got = [(r.success, r.version, r.HIGH) for r in tx.validate_revision(df).orderBy("i").collect()]
    assert got == [(True, "1", ["a"])] * 3 + [(False, "0", ["h"])] * 2


def test_normalize_and_prompt(spark):
    df = spark.createDataFrame([("d", " A&amp;B \n c ")], "domain string, text string")
    assert df.select(tx.normalize_text(F.col("text")).alias("x")).first().x == "a&b c"
    rubric = spark.createDataFrame([("d", "ctx", ["x", "y"], ["z"], "rule")], "domain string, domain_context string, HIGH array<string>, LOW array<string>, conflict_rule string")
    assert "1. x\n2. y" in tx.render_prompt(df, rubric).first().prompt


def test_sources_round_trip(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿domain,transcript\na,"one ""quoted""\nline"\n', encoding="utf-8")
    assert tables.read_items_csv(spark, str(path)).collect()[0].text == 'one "quoted"\nline'
    (tmp_path / "r.json").write_text(json.dumps({"d": {"version": 1, "domain_context": "c", "HIGH": ["h"], "LOW": [], "conflict_rule": "r"}}))
    assert tables.read_rubrics(spark, str(tmp_path / "r.json")).first().version == "1"
    indexed = votes.with_row_index(spark.createDataFrame([("a",), ("b",)], "domain string"))
    assert [r.item_id for r in indexed.orderBy("item_id").collect()] == [0, 1]


def test_alignment_and_excerpts(spark):
    items = spark.createDataFrame([("d", 1, "x " + " ".join(f"w{i}" for i in range(60))), ("d", 2, "other")], "domain string, item_id long, text string")
    probes = spark.createDataFrame([("d", 7, items.first().text), ("d", 8, "short")], "domain string, probe_id long, text string")
    assert [(r.probe_id, r.item_id) for r in pairs.link_by_excerpt(probes, items).collect()] == [(7, 1)]
    assert pairs.verify_alignment(items, items.where("item_id = 1")).first().problem == "missing_b"


def test_loop_resumes(spark, tmp_path):
    items = spark.createDataFrame([("d", i, "x" * (100 * i)) for i in range(12)], "domain string, item_id long, text string")
    rubrics = spark.createDataFrame([("d", "0", "c", ["h"], ["l"], "r")], "domain string, version string, domain_context string, HIGH array<string>, LOW array<string>, conflict_rule string")
    answer = json.dumps({"updated_HIGH": ["a"], "updated_LOW": ["b"], "updated_conflict_rule": "c"})
    log = str(tmp_path / "log")
    run = lambda: loop.calibrate(items, rubrics, ["a", "b", "c"], loop.rule_rater, lambda *_: answer, log, tau=1.1, max_iterations=2)
    first = run()[0].collect()
    calls = loop.read_log(spark, log).count()
    assert calls == 2 * 3 * 12 and run()[0].collect() == first and loop.read_log(spark, log).count() == calls
    assert [r.rubric_version for r in first] == ["0", "1"]


def test_stream_equals_batch(spark, tmp_path):
    df = ratings(spark, [("a", ["HIGH", "LOW", "HIGH"], 5), ("b", ["LOW"] * 3, 4)])
    df.where("rater_id <> 'r2'").write.parquet(str(tmp_path / "in"))
    sink = intake.PanelMetricsTable(str(tmp_path / "votes"))
    run = lambda: intake.stream_panel_votes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), sink, str(tmp_path / "cp")).awaitTermination()
    run()
    df.where("rater_id = 'r2'").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(map(str, sink.metrics(spark).collect())) == sorted(map(str, metrics.panel_metrics(df).collect()))


def test_disagreement_cases_hold_votes_and_quotes(spark, tmp_path):
    from panelmark.jobs import loop
    from panelmark.operators.votes import disagreement_cases, panel_vote

    rows = [("d", 1, "a", "HIGH", 'say "x"\\y'), ("d", 1, "b", "LOW", None), ("d", 1, "b", "LOW", "z"), ("d", 2, "a", "HIGH", "q"), ("d", 2, "b", "HIGH", "q")]
    items = spark.createDataFrame([("d", 1, "some text"), ("d", 2, "other")], "domain string, item_id long, text string")
    panel = panel_vote(spark.createDataFrame(rows, "domain string, item_id long, rater_id string, label string, criterion_quote string"), details=True)
    (got,) = disagreement_cases(panel, items, 4, 6).collect()
    assert (got.item_id, got.excerpt, got.votes, got.quotes) == (1, "some", {"a": "HIGH", "b": "LOW, LOW"}, {"a": "say 'x", "b": "z"})

    def rater(name, frame):
        return frame.assign(label="HIGH" if name == "a" else "LOW", confidence="HIGH", reason="", criterion_quote=f"by {name}")[list(loop.FIELDS)]

    seen = []
    rubrics = spark.createDataFrame([("d", "0", "c", ["h"], ["l"], "r")], "domain string, version string, domain_context string, HIGH array<string>, LOW array<string>, conflict_rule string")
    answer = json.dumps({"updated_HIGH": ["a"], "updated_LOW": ["b"], "updated_conflict_rule": "c"})
    loop.calibrate(items, rubrics, ["a", "b"], rater, lambda domain, rubric, cases, changes: seen.extend(cases) or answer, str(tmp_path / "log"), tau=1.1, max_iterations=2)
    assert [(c["votes"], c["quotes"]) for c in seen] == [({"a": "HIGH", "b": "LOW"}, {"a": "by a", "b": "by b"})] * 2


def test_row_index_within_groups_has_no_gaps(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("domain"), F.col("id"), F.rand(1).alias("r")).repartition(5)
    by = {}
    for r in votes.with_row_index(df, order=["r"], by=["domain"], name="at").collect():
        by.setdefault(r.domain, []).append((r.r, r["at"]))
    assert all([i for _, i in sorted(v)] == list(range(len(v))) for v in by.values()) and len(by) == 3
    empty = df.where("id < 0")
    assert votes.with_row_index(empty).count() == votes.with_row_index(empty, ["r"], ["domain"]).count() == 0


def test_short_excerpts_meet_their_words(spark):
    probes = spark.createDataFrame([(i, "x" * 50 + s) for i, s in enumerate(["abc def", "hello wor", "qq one two th", "NO", "", "orl", " "])], "probe_id long, text string")
    items = spark.createDataFrame([(10, "xx abc defg"), (11, "othello world"), (12, "qq one two three"), (13, "pabc defx")], "item_id long, text string")
    got = {r.probe_id: r.item_id for r in pairs.link_by_excerpt(probes, items, by=(), normalized=False).collect()}
    assert got == {0: 10, 1: 11, 2: 12, 5: 11, 6: 10}
    plan = pairs.link_by_excerpt(probes, items, by=())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_item_folds_shuffle_once(spark):
    df = ratings(spark, [("g", ["A", "B", "B"], 4), ("g", ["C", "C"], 2)])
    assert exchanges(metrics.item_shapes(df)) == 1 and exchanges(metrics.gwet_ac1_nominal(df)) == 4


def test_cluster_draws_come_in_blocks(spark, monkeypatch):
    """Blocks of the patterns together draw what one block draws, up to chance; groups are the same size in each draw."""
    df = spark.range(400).select(F.lit("d").alias("domain"), (F.col("id") % 80).alias("cluster_id"), (F.col("id") % 7 + F.col("id") % 80 / 40.0).alias("value"))
    whole = resample.cluster_bootstrap_ci(df, "value", draws=2000).first()
    monkeypatch.setattr(resample, "BLOCK", 16)
    parts = resample.cluster_bootstrap_ci(df, "value", draws=2000).first()
    assert (parts.n, parts.units, parts.mean, parts.kept) == (400, 80, whole.mean, 2000)
    assert abs(parts.low - whole.low) < 0.1 and abs(parts.high - whole.high) < 0.1
    sums = resample.cluster_sums(df, "value").groupBy("domain", F.round("value", 12).alias("value"), "size").agg(F.count(F.lit(1)).alias("items"))
    draws = resample.ratio_draws(sums, ("domain",), 300, 0)
    mean, spread = draws.agg(F.avg("value"), F.stddev("value")).first()
    exact = df.groupBy("cluster_id").agg(F.avg("value").alias("v")).agg(F.stddev_pop("v")).first()[0] / 80**0.5
    assert abs(mean - whole.mean) < 0.05 and abs(spread / exact - 1) < 0.2


def scripted(values):
    """A rater pair that agrees on the share of items that the iteration asks for."""

    def rater(name, frame):
        share = values[int(frame["rubric_version"].iloc[0]) - 1]
        agree = (frame["item_id"] < round(share * 100)) | (name == "a")
        import pandas as pd

        return pd.DataFrame({"label": agree.map({True: "HIGH", False: "LOW"}), "confidence": "HIGH", "reason": "", "criterion_quote": ""})

    return rater


def test_loop_skips_converged_domains_and_opens_those_that_fall(spark, tmp_path):
    items = spark.createDataFrame([("d", i, "t") for i in range(100)], "domain string, item_id long, text string")
    rubrics = spark.createDataFrame([("d", "0", "c", ["h"], ["l"], "r")], "domain string, version string, domain_context string, HIGH array<string>, LOW array<string>, conflict_rule string")
    answer = json.dumps({"updated_HIGH": ["a"], "updated_LOW": ["b"], "updated_conflict_rule": "c", "reasoning": "so", "irreducible_transcripts": [99]})
    asked = []
    # 0.5 -> 0.95 (converged) -> 0.84, a fall of 11 points (open again) -> 0.97 (converged) -> 0.96 (stable, then skipped)
    found = loop.calibrate(items, rubrics, ["a", "b"], scripted([0.5, 0.95, 0.84, 0.97, 0.96, 0.1, 0.1]), lambda d, r, cases, changes: asked.append((r["version"], len(changes))) or answer, str(tmp_path / "log"), tau=0.9, max_iterations=7, split_weight=0.0)
    assert [(r.iteration, r.rubric_version) for r in found.history.orderBy("iteration").collect()] == [(1, "0"), (2, "1"), (3, "1"), (4, "2"), (5, "2")]
    assert loop.read_log(spark, str(tmp_path / "log")).select("run_tag").distinct().count() == 5 and asked == [("0", 0), ("1", 1)]
    s = found.summary.first()
    assert (s.converged, s.regression_detected, s.rubric_changes, s.irreducible_count, s.iterations) == (True, True, 2, 1, 5)
    assert found.irreducible.collect() == [("d", 99)] and found.rubrics.first().version == "2"


def test_reviser_is_asked_again(spark):
    current = spark.createDataFrame([("d", "0", "c", ["h"], ["l"], "r"), ("e", "4", "c", ["h"], ["l"], "r")], "domain string, version string, domain_context string, HIGH array<string>, LOW array<string>, conflict_rule string")
    good, calls = json.dumps({"updated_HIGH": ["a"], "updated_LOW": ["b"], "updated_conflict_rule": "c"}), []

    def reviser(domain, *_):
        calls.append(domain)
        if domain == "e":
            raise RuntimeError("busy")
        return good if len(calls) > 2 else "no json"

    got = loop.revise(current, {"d": ({}, [], []), "e": ({}, [], [])}, reviser, 3)
    assert (got["d"]["success"], got["d"]["attempts"], got["d"]["version"]) == (True, 2, "1")
    assert (got["e"]["success"], got["e"]["attempts"], got["e"]["version"]) == (False, 3, "4") and calls == ["d", "e", "d", "e", "e"]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "career_holdout.jsonl").write_text('{"transcript": "one", "x": 1}\n\n{"transcript": "two"}\n')
    assert sorted(tables.read_items_jsonl(spark, str(tmp_path / "*.jsonl")).collect()) == [("career", "one"), ("career", "two")]
    panel = tmp_path / "panel.csv"
    panel.write_text('domain,transcript_index,signal_level,agreement,votes_high,votes_low,all_agree,a_label,b_label\nd,0,HIGH,1.0,2,0,True,HIGH,HIGH\nd,1,LOW,0.5,1,1,False,HIGH,\n')
    read = tables.read_panel_labels(spark, str(panel))
    assert [(r.item_id, r.all_agree, r.votes_high) for r in read.orderBy("item_id").collect()] == [(0, True, 2), (1, False, 1)]
    assert sorted(map(tuple, tables.panel_to_ratings(read, {"a_label": "a", "b_label": "b"}).collect()), key=str) == [("d", 0, "a", "HIGH"), ("d", 0, "b", "HIGH"), ("d", 1, "a", "HIGH"), ("d", 1, "b", None)]
    human = tmp_path / "human.csv"
    human.write_text('domain,round,transcript_index,item_id,is_attention_check,annotator_id,included_in_consensus,label,confidence,justification\nd,1,4,x,False,h1,TRUE,HIGH,5,"two\nlines, ""quoted"""\nd,1,,chk,true,h1,True,LOW,1,\n')
    rows = tables.read_human_ratings(spark, str(human)).collect()
    assert [(r.item_id, r.is_attention_check, r.included_in_consensus, r.confidence) for r in rows] == [(4, False, True, 5), (None, True, True, 1)] and rows[0].justification == 'two\nlines, "quoted"'
    batch = tmp_path / "batch.csv"
    batch.write_text("Question,transcript,transcript_id,Annotator1_Response,Annotator2_Response\nTech: a?,t,1, high ,Low\nOther,t,2,High,High\nTech: b?,t,3,,LOW\n")
    got = tables.read_batch_export(spark, str(batch), "Tech")
    assert sorted((r.transcript_id, r.rater_id, r.label) for r in got.collect()) == [("1", "Annotator1", "HIGH"), ("1", "Annotator2", "LOW"), ("3", "Annotator2", "LOW")]
    with pytest.raises(ValueError, match="lack keys"):
        pairs.require_complete(read, {"other": read.where("item_id = 0")})
    assert pairs.require_complete(read, {"same": read}) is None


def test_running_votes_are_compacted(spark, tmp_path):
    sink = intake.PanelMetricsTable(str(tmp_path / "votes"), compact_every=2)
    for i in range(5):
        sink(spark.createDataFrame([("d", 1, 1, i % 2), ("d", 10 + i, 2, 2)], "domain string, item_id long, n long, h long"), i)
    sink(spark.createDataFrame([("d", 1, 1, 1)], "domain string, item_id long, n long, h long"), 1)  # replayed, in the base already
    assert sorted(p.name for p in (tmp_path / "votes").iterdir()) == ["base-3", "batch-4"]
    assert {r.item_id: (r.n, r.h) for r in sink.votes(spark).collect()} == {1: (5, 2), **{10 + i: (2, 2) for i in range(5)}}


def test_texts_stay_out_of_shuffles_and_rubrics_are_broadcast(spark, tmp_path):
    from panelmark.jobs import queries

    folder = "/root/testdata/sf0.001"
    plan = queries.QUERIES["a10_panel_metrics"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "text" in x]
    linked = pairs.link_by_excerpt(spark.createDataFrame([(1, "x" * 60)], "probe_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string"), by=())
    assert "CartesianProduct" not in linked._jdf.queryExecution().executedPlan().toString()
    items = spark.createDataFrame([("d", 1, "t")], "domain string, item_id long, text string")
    rubric = spark.createDataFrame([("d", "c", ["x"], ["z"], "r")], "domain string, domain_context string, HIGH array<string>, LOW array<string>, conflict_rule string")
    rubric.write.parquet(str(tmp_path / "rubrics"))
    small = spark.read.parquet(str(tmp_path / "rubrics"))
    assert "BroadcastHashJoin" in tx.render_prompt(items, small)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_for_rubrics_of_unknown_size(spark):
    """Rubrics that Spark takes for large, as they are counted from the items, are broadcast all the same."""
    items = spark.createDataFrame([("d", i, "t") for i in range(9)], "domain string, item_id long, text string")
    rubric = items.groupBy("domain").agg(F.max("text").alias("domain_context")).select("domain", F.lit("1").alias("version"), "domain_context", F.array(F.lit("x")).alias("HIGH"), F.array(F.lit("y")).alias("LOW"), F.lit("r").alias("conflict_rule"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (tx.render_prompt(items, rubric), pairs.attach_rubric(items, rubric)):
            assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_of_raters_do_not_grow_with_the_square_of_the_calls(spark):
    from panelmark.jobs import loop

    pending = spark.range(40).select(F.lit("run").alias("run_tag"), F.lit("d").alias("domain"), F.lit("v").alias("rubric_version"), F.col("id").alias("item_id"), F.lit("a").alias("rater_id"), F.lit(0).alias("repeat"), F.lit("t").alias("text"))
    cores = spark.sparkContext.defaultParallelism
    found = loop.label_items(pending, loop.rule_rater, calls=500_000)
    assert found.rdd.getNumPartitions() == 8 * cores and found.count() == 40
    assert loop.label_items(pending, loop.rule_rater, calls=257).rdd.getNumPartitions() == 2


def test_plurality_is_dealt_by_the_size_of_its_files(spark, tmp_path, monkeypatch):
    from panelmark.sources import shared

    rows = [("d" if i % 3 else None, i, r, "HIGH" if (i + r) % 3 else "LOW") for i in range(300) for r in range(3)]
    df = spark.createDataFrame(rows, "domain string, item_id long, rater_id long, label string")
    df.write.parquet(str(tmp_path / "r"))
    monkeypatch.setattr(shared, "TASK_BYTES", 200)
    read = spark.read.parquet(str(tmp_path / "r"))
    assert shared.tasks_for(read) > 4
    got = votes.majority(read, "plurality_first")
    assert f", {shared.tasks_for(read)})" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, votes.majority(df, "plurality_first").collect()))
