"""Row numbers, null keys, clashing names and ties."""

import pytest
from pyspark.sql import functions as F

from panelmark.operators import keys, votes


def positions(df, name="position"):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"), F.count_distinct(name).alias("different")).first()
    return tuple(r)


@pytest.mark.parametrize("file_bytes", ["128m", "1m"])
def test_row_index_of_shuffled_rows_loses_none(spark, tmp_path, file_bytes):
    """600,000 grouped rows under Spark's own settings, written out: every position once."""
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", "200")
    s.conf.set("spark.sql.files.maxPartitionBytes", file_bytes)
    s.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", file_bytes)
    grouped = s.range(1_200_000).groupBy((F.col("id") % 600_000).alias("k")).agg(F.count(F.lit(1)).alias("part"), F.max("id").alias("place"))
    votes.with_row_index(grouped, name="position").write.parquet(f"{tmp_path}/numbered")
    got = s.read.parquet(f"{tmp_path}/numbered")
    assert got.columns == ["k", "part", "place", "position"]
    assert positions(got) == (600_000, 0, 599_999, 600_000)
    assert got.select("k").distinct().count() == 600_000 and got.where("place <> k + 600000 or part <> 2").count() == 0


def test_row_index_keeps_columns_of_its_own_names_and_null_groups(spark):
    rows = [(d, i % 7, i, "x", float(i)) for i, d in enumerate(["a", None, "b", "a", None, "a"] * 40)]
    df = spark.createDataFrame(rows, "g string, o int, _part int, _at string, _n double").repartition(5)
    got = votes.with_row_index(df, order=["o"], by=["g"], name="position").collect()
    for g in ("a", "b", None):
        own = sorted((r.position, r.o) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own)
    assert sorted((r._part, r._at, r._n) for r in got) == sorted(r[2:] for r in rows)
    again = votes.with_row_index(df.repartition(2), order=["o"], by=["g"], name="position").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # ties come by a hash of the row
    assert votes.with_row_index(df.limit(0), name="position").count() == 0
    assert positions(votes.with_row_index(df, name="_PART"), "_PART") == (240, 0, 239, 240)


def test_latest_call_of_ties_and_own_names(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 9, 4), (None, 3, 1)], "k string, _rank int, ingest_seq int")
    got = sorted(votes.latest_call(df, ("k",)).collect(), key=str)
    assert got == sorted(votes.latest_call(df.repartition(4), ("k",)).collect(), key=str)
    assert len(got) == 2 and got[0].asDict().keys() == {"k", "_rank", "ingest_seq"} and {r.ingest_seq for r in got} == {5, 1}


@pytest.mark.parametrize("how", ["inner", "left", "full", "left_semi", "left_anti"])
def test_null_keys_meet(spark, how):
    a = spark.createDataFrame([(None, 1, "p"), ("x", 2, "q"), ("y", None, "r")], "k string, i int, a string")
    b = spark.createDataFrame([(None, 1, "s"), ("y", None, "t"), ("z", 3, "u")], "k string, i int, b string")
    both, only_a, only_b = {(None, 1, "p", "s"), ("y", None, "r", "t")}, {("x", 2, "q", None)}, {("z", 3, None, "u")}
    want = {"inner": both, "left": both | only_a, "full": both | only_a | only_b, "left_semi": {r[:3] for r in both}, "left_anti": {r[:3] for r in only_a}}
    assert set(map(tuple, keys.joined(a, b, ("k", "i"), how).collect())) == want[how]


def test_pending_calls_of_items_without_a_domain_end(spark):
    from panelmark.operators import pairs

    items = spark.createDataFrame([(None, 1), ("d", 2)], "domain string, item_id long")
    plan = pairs.plan_calls(items, spark.createDataFrame([("a",)], "rater_id string"), spark.createDataFrame([("v",)], "rubric_version string"))
    assert pairs.pending_calls(plan, plan.limit(0)).count() == 2 and pairs.pending_calls(plan, plan).count() == 0
    labels = plan.withColumn("label", F.lit("LOW"))
    assert pairs.pair_labels(labels, labels).count() == 2 and pairs.exclude_items(items, items).count() == 0
    text = items.withColumn("text", F.when(F.col("item_id") == 2, "t"))
    assert pairs.verify_alignment(text, text).count() == 0
    assert {(r.domain, r.problem) for r in pairs.verify_alignment(text, text.withColumn("text", F.lit("u"))).collect()} == {(None, "text"), ("d", "text")}


def test_repairs_of_quotes_that_are_no_strings(spark):
    from panelmark.functions import text as tx

    given = ['{"criterion_quote": "a "b" c", "n": 1}', 'x {"n": 2, "criterion_quote":"q\\z "w"" } y', '{"criterion_quote" : "end\\\\\\\\", "n": 3}', '{"criterion_quote": "no end', '{"n": 5, "criterion_quote": "a "x", y"}',
             '[{"criterion_quote": "a "b""}, {"criterion_quote": "\\q", "n": 1}]', '{"criterion_quote": 7, "n": 7 "x"}', None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", F.try_variant_get(tx.repair_json(F.col("t")), "$.n", "int").alias("n")).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None}
    emptied = [r[0] for r in df.where("i in (0, 1, 5)").orderBy("i").select(tx.without_quotes(F.col("t"))).collect()]
    assert emptied == ['{"criterion_quote": "", "n": 1}', 'x {"n": 2, "criterion_quote": "" } y', '[{"criterion_quote": ""}, {"criterion_quote": "", "n": 1}]']
    numbers = spark.range(1).select(tx.parse_int_list(F.lit("1, 99999999999,x, 2147483647")).alias("n")).first().n
    assert numbers == [1, 2147483647]


@pytest.mark.parametrize("few", [200_000, 0])
@pytest.mark.parametrize("normalized", [False, True])
def test_excerpts_against_every_text(spark, monkeypatch, few, normalized):
    """Random words: the first item that holds the slice, with broadcast slices and with shuffled ones; blanks, stop words,
    cut words, null groups and texts, repeated probes."""
    import random

    from panelmark.operators import pairs

    monkeypatch.setattr(pairs, "BROADCAST_SLICES", few)
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "of", "a", "longwordindeedlonger", "x1", "ab"]) if rng.random() < 0.7 else f"w{rng.randrange(300)}"
    texts = [(rng.choice(["p", "q", None]), i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)] + [("p", 500, None), ("p", 501, "")]
    probes = []
    for i in range(60):
        g, _, t = rng.choice(texts)
        at = rng.randrange(max(1, len(t or "") - 5))
        probes.append((g, i, "y" * 50 + (t or "")[at : at + rng.choice([1, 2, 4, 9, 20, 60])]))
    probes += [("p", 90, "y" * 50 + " "), (None, 91, "y" * 50 + "the"), ("q", 92, "short"), ("q", 93, None), ("p", 94, "y" * 50 + " the "), ("p", 90, "y" * 50 + "  "), ("p", 95, "y" * 50 + "indeedlonge")]
    clean = (lambda t: " ".join(t.lower().split())) if normalized else (lambda t: t)
    want = {}
    for g, i, t in probes:
        s = clean(t or "")[50:150]
        held = [k for h, k, x in texts if s and x is not None and h == g and s in clean(x)]
        if held:
            want[i] = min([*held, *([want[i]] if i in want else [])])
    items = spark.createDataFrame(texts, "domain string, item_id long, text string").repartition(3)
    got = pairs.link_by_excerpt(spark.createDataFrame(probes, "domain string, probe_id long, text string"), items, normalized=normalized)
    assert {r.probe_id: r.item_id for r in got.collect()} == want and len(want) > 40


def test_excerpts_of_common_words_stay_in_their_tasks(spark):
    """A blank slice, a stop word and a rare phrase against 300,000 items: no shuffle carries a text, nor one row per item."""
    from panelmark.operators import pairs

    items = spark.range(300_000).select(F.lit("d").alias("domain"), F.col("id").alias("item_id"), F.concat(F.lit("xx the yy "), F.hex(F.xxhash64("id")), F.lit(" zz of ww")).alias("text"))
    probes = spark.createDataFrame([("d", 1, "y" * 50 + " "), ("d", 2, "y" * 50 + "xx the yy"), ("d", 3, "y" * 50 + "y " + format(0, "x"))], "domain string, probe_id long, text string")
    got = pairs.link_by_excerpt(probes, items, normalized=False)
    assert {r.probe_id: r.item_id for r in got.collect()}.items() >= {1: 0, 2: 0}.items()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and ("body" in x or "anchor" in x)]


def test_bucketed_log_is_read_where_it_lies(spark, tmp_path):
    """Folds, last calls, rater pairs and pending calls: no exchange above the scan of the log; a second session's table of
    the same path sees the same rows."""
    from panelmark.operators import pairs, raters
    from panelmark.sources.calls import COLUMNS, CallLog

    log = CallLog(spark, "calls_of_a_test", f"{tmp_path}/log", 4)
    rows = [("run", d, "v", i, r, 0, "HIGH" if i % 2 else "LOW", None, None, None) for i in range(50) for d in ("d", None) for r in ("a", "b")]
    df = spark.createDataFrame(rows, COLUMNS)
    log.append(df.where("rater_id = 'a'"))
    log.append(df.where("rater_id = 'b'"))
    assert log.read().count() == 200 and CallLog(spark, "calls_again", f"{tmp_path}/log", 4).read().count() == 200
    plan = pairs.plan_calls(df.select("domain", "item_id").distinct(), spark.createDataFrame([("a",), ("b",), ("c",)], "rater_id string"), spark.createDataFrame([("v",)], "rubric_version string"))
    left = log.pending(plan)
    assert sorted(map(str, left.collect())) == sorted(map(str, plan.where("rater_id = 'c'").collect())) and left.columns == plan.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, frame in {"votes": votes.panel_vote(log.read()), "last": votes.latest_call(log.read(), pairs.CALL, "repeat"), "pending": log.pending(spark.createDataFrame(plan.collect(), plan.schema))}.items():
            plan_text = frame._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan_text and plan_text.count("Exchange hashpartitioning") == (name == "pending"), plan_text
        folded = raters.rater_pair_matrix(log.read())._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(domain" in folded and "hashpartitioning(domain#0, item_id" not in folded and "item_id" not in "".join(x for x in folded.splitlines() if "Exchange" in x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report_sections_are_sorted_files(spark, tmp_path):
    from panelmark.sources import tables

    parts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("section"), F.when(F.col("id") % 7 > 0, F.format_string("d%05d", (F.col("id") * 7919) % 3000)).alias("domain"), F.col("id").alias("n"))
    tables.write_report(parts.repartition(5), f"{tmp_path}/report")
    got = tables.read_report(spark, f"{tmp_path}/report", "domain string, n long")
    assert sorted(map(str, got.collect())) == sorted(map(str, parts.collect()))
    import json

    for section in ("a", "b"):
        files = sorted((tmp_path / "report" / f"section={section}").glob("part-*.json"))
        domains = [json.loads(x)["domain"] or "" for f in files for x in f.read_text().splitlines()]
        assert domains == sorted(domains) and len(domains) == (1000 if section == "a" else 2000)


def test_reviser_gets_history_and_reasons_and_diagnoses_are_kept(spark, tmp_path):
    import json

    import pandas as pd

    from panelmark.jobs import loop

    items = spark.createDataFrame([("d", i, "t") for i in range(4)], "domain string, item_id long, text string")
    rubrics = spark.createDataFrame([("d", "0", "c", ["h"], ["l"], "r")], "domain string, version string, domain_context string, HIGH array<string>, LOW array<string>, conflict_rule string")
    seen = []

    def rater(name, frame):
        return pd.DataFrame({"label": ["HIGH" if name == "a" else "LOW"] * len(frame), "confidence": "HIGH", "reason": f"so says {name}", "criterion_quote": ""})

    def reviser(domain, rubric, cases, changes):
        seen.append((rubric["agreement_history"], [c["reasons"] for c in cases], [c["diagnosis"] for c in changes]))
        return json.dumps({"updated_HIGH": ["a"], "updated_LOW": ["b"], "updated_conflict_rule": "c", "diagnosis": "vague" if len(seen) == 1 else {"d": [1]}})

    found = loop.calibrate(items, rubrics, ["a", "b"], rater, reviser, str(tmp_path / "log"), tau=1.1, max_iterations=3)
    assert [(len(h), d) for h, _, d in seen] == [(1, []), (2, ["vague"])] and all(abs(x - 0.667) < 1e-9 for x in seen[1][0])
    assert seen[0][1] == [{"a": "so says a", "b": "so says b"}] * 4
    assert [r.diagnosis for r in found.changes.orderBy("iteration").collect()] == ["vague", '{"d":[1]}']
