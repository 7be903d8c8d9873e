"""Bootstrap intervals: published figures, blocks of patterns, and draws that brute force repeats."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.jobs.fixtures import fixture
from panelmark.operators import metrics, reference, resample

# How many items of a domain and round have (HIGH, LOW) votes of three people, as published.
PEOPLE = {
    ("career", 1): {(0, 3): 2, (1, 2): 4, (2, 1): 1, (3, 0): 3},
    ("career", 2): {(1, 2): 1, (2, 1): 6, (3, 0): 3},
    ("education", 1): {(1, 2): 1, (2, 1): 3, (3, 0): 6},
    ("education", 2): {(2, 1): 3, (3, 0): 7},
    ("tech", 1): {(1, 2): 1, (2, 1): 3, (3, 0): 6},
    ("tech", 2): {(1, 2): 4, (2, 1): 4, (3, 0): 2},
}
# Items by (people's majority, system's label), of ten items each, in the order of PEOPLE.
SYSTEM = (
    {("LOW", "LOW"): 1, ("LOW", "HIGH"): 5, ("HIGH", "HIGH"): 4},
    {("LOW", "HIGH"): 1, ("HIGH", "HIGH"): 8, ("HIGH", "LOW"): 1},
    {("LOW", "HIGH"): 1, ("HIGH", "HIGH"): 9},
    {("HIGH", "HIGH"): 10},
    {("LOW", "HIGH"): 1, ("HIGH", "HIGH"): 5, ("HIGH", "LOW"): 4},
    {("LOW", "HIGH"): 1, ("LOW", "LOW"): 3, ("HIGH", "HIGH"): 5, ("HIGH", "LOW"): 1},
)


def people(spark):
    rows, item = [], 0
    for (domain, turn), votes in PEOPLE.items():
        for (high, low), times in votes.items():
            for _ in range(times):
                rows += [(domain, turn, item, f"h{i}", "HIGH" if i < high else "LOW") for i in range(high + low)]
                item += 1
    return spark.createDataFrame(rows, "domain string, round int, item_id long, rater_id string, label string")


def near(got, want, off=0.03):
    return all(abs(a - b) <= off for a, b in zip(got, want, strict=True))


def test_published_intervals_of_people(spark):
    """AC1 of 20 items a domain, 10,000 draws.  Bounds may differ by a step of the draws."""
    got = {r.domain: r for r in resample.bootstrap_ac1_ci(people(spark)).collect()}
    want = {"education": (0.6965, 0.4291, 0.8895), "tech": (0.3265, -0.02, 0.6421), "career": (0.2413, -0.0561, 0.562)}
    for domain, (value, low, high) in want.items():
        r = got[domain]
        assert r.n_items == 20 and r.value == pytest.approx(value, abs=5e-5) and near((r.low, r.high), (low, high)), r
        assert r.kept >= 9990


def test_published_differences(spark):
    got = {(r.a, r.b): r for r in resample.difference_ci(people(spark), [("education", "tech"), ("education", "career"), ("tech", "career")]).collect()}
    want = {("education", "tech"): (0.3701, -0.0362, 0.7688, False), ("education", "career"): (0.4552, 0.0402, 0.8033, True), ("tech", "career"): (0.0852, -0.3935, 0.523, False)}
    for pair, (difference, low, high, excludes) in want.items():
        r = got[pair]
        assert r.difference == pytest.approx(difference, abs=1e-4) and near((r.low, r.high), (low, high)) and r.excludes_zero == excludes, r


def test_published_shift_of_cohorts(spark):
    got = {r.group: r for r in resample.cohort_shift(people(spark), "round", 1, 2).collect()}
    want = {"education": (-0.1253, -0.6141, 0.3113, False), "tech": (0.6564, 0.0284, 1.1078, True)}
    for domain, (difference, low, high, excludes) in want.items():
        r = got[domain]
        assert r.difference == pytest.approx(difference, abs=1e-4) and near((r.low, r.high), (low, high), 0.06) and r.excludes_zero == excludes, r


def test_published_means(spark):
    """19 of 30 matches, and 6 of 30 items that gained a third of a point (0.333)."""
    rows = [("matches", 1.0 if i < 19 else 0.0) for i in range(30)] + [("gain", 0.333 if i < 6 else 0.0) for i in range(30)]
    got = {r.domain: r for r in resample.bootstrap_mean_ci(spark.createDataFrame(rows, "domain string, value double"), "value").collect()}
    assert near((got["matches"].mean, got["matches"].low, got["matches"].high), (0.6333, 0.4667, 0.8), 1e-3)
    assert near((got["gain"].mean, got["gain"].low, got["gain"].high), (0.0666, 0.0222, 0.111), 0.0112)  # a step of the mean


def test_published_matches_of_cells(spark):
    rows = [(*key, *pair) for key, pairs in zip(PEOPLE, SYSTEM, strict=True) for pair, n in pairs.items() for _ in range(n)]
    cells = reference.match_vs_baseline(spark.createDataFrame(rows, "domain string, round int, label_a string, label_b string"), ("domain", "round"))
    pooled = reference.pooled_baseline(cells).first()
    assert (pooled.match, pooled.n, pooled.cells_above) == (45, 60, 1) and pooled.baseline == pytest.approx(0.8333, abs=1e-4)


def test_groups_of_any_name_come_back(spark):
    df = people(spark).where("domain = 'tech'").withColumn("domain", F.when(F.col("item_id") % 2 == 0, "a|1").otherwise(F.lit(None)))
    got = sorted((str(r.group) for r in resample.cohort_shift(df, "round", 1, 2, draws=50).collect()))
    assert got == ["", "a|1"]


def nominal(spark, groups=("x", None), items=60, seed=1):
    """Items of one to five labels of four kinds."""
    rng = random.Random(seed)
    rows = [(g, i, f"r{k}", rng.choice("ABCD"[: 2 + (g is None)])) for g in groups for i in range(items) for k in range(rng.randint(1, 5))]
    return spark.createDataFrame(rows, "domain string, item_id long, rater_id string, label string")


def brute(statistic, items, labels_known):
    """The statistic of a list of items, each a list of labels; nan where it is undefined."""
    from collections import Counter
    from itertools import combinations

    counts = [Counter(x) for x in items]
    if statistic == "weighted":
        return np.mean([1 if len(c) == 1 else 2 / 3 for c in counts])
    if statistic == "all_agree":
        return np.mean([len(c) == 1 for c in counts])
    if statistic == "gwet_ac1_nominal":
        own = [(x, c) for x, c in zip(items, counts, strict=True) if len(x) >= 2]
        kinds = {y for x, _ in own for y in x}
        if len(kinds) < 2:
            return np.nan
        po = np.mean([np.mean([a == b for a, b in combinations(x, 2)]) for x, _ in own])
        pi = [np.mean([c[k] / len(x) for x, c in own]) for k in kinds]
        pe = sum(p * (1 - p) for p in pi) / (len(kinds) - 1)
        return (po - pe) / (1 - pe)
    pairs = [a == b for x in items for a, b in combinations(x, 2)]
    if not pairs:
        return np.nan
    po = np.mean(pairs)
    every = [y for x in items for y in x]
    p = [every.count(k) / len(every) for k in set(every)]
    if statistic == "pairwise":
        return po
    pe = sum(x * x for x in p) if statistic == "fleiss_kappa" else sum(x * (1 - x) for x in p) / max(labels_known - 1, 1)
    return np.nan if abs(1 - pe) < 1e-8 else (po - pe) / (1 - pe)


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("statistic", resample.STATISTICS)
def test_kernel_against_resampled_items(spark, monkeypatch, statistic, block):
    """Every draw by md5, through the kernel of the intervals, against the statistic of the items drawn; draw -1 is that
    of all items.  In one block and in many."""
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "CHUNK", 4)
    monkeypatch.setattr(resample, "LABELS", 2)
    df, draws = nominal(spark), 9
    items = {}
    for r in df.collect():
        items.setdefault(r.domain, {}).setdefault(r.item_id, []).append(r.label)
    want = {}
    for g, own in items.items():
        rows = [own[i] for i in sorted(own)]
        known = len({y for x in rows for y in x})
        want[g, -1] = brute(statistic, rows, known)
        for b in range(draws):
            drawn = [rows[int(hashlib.md5(f"s|{b}|{i}".encode()).hexdigest()[:8], 16) % len(rows)] for i in range(len(rows))]
            want[g, b] = brute(statistic, drawn, known)
    got = {(r.domain, r.draw): r for r in resample.panel_draws(df, statistic, draws=draws, md5_seed="s").collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k].n_items == 60 and (got[k].value is None if np.isnan(v) else got[k].value == pytest.approx(v, abs=1e-12)), k


@pytest.mark.parametrize("statistic", ["gwet_ac1_nominal", "fleiss_kappa", "weighted"])
def test_blocks_draw_what_one_block_draws(spark, monkeypatch, statistic):
    """Random draws in one block and in many: mean and spread of the statistic agree, each draw has all items, and a task
    holds no more than its block."""
    df = nominal(spark, ("x",), 400, 3)
    seen = []
    for block in (4096, 8):
        monkeypatch.setattr(resample, "BLOCK", block)
        values = resample.panel_draws(df, statistic, draws=2000, seed=block).where("draw >= 0")
        assert values.where("n_items <> 400").count() == 0
        seen.append(values.agg(F.avg("value"), F.stddev("value")).first())
    (m1, s1), (m2, s2) = seen
    assert abs(m1 - m2) < 4 * s1 / 2000**0.5 * 1.5 and abs(s1 / s2 - 1) < 0.08


def test_a_task_holds_a_block(spark, monkeypatch):
    """20,000 different patterns of one group, blocks of 512: no call of the kernel sees more than about a block."""
    monkeypatch.setattr(resample, "BLOCK", 512)
    patterns = spark.range(20_000).select(F.lit("g").alias("domain"), F.col("id").cast("string").alias("pattern"), F.lit(3).cast("long").alias("items"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("total"), F.array().cast("array<struct<label:string,v:array<double>>>").alias("labels"))
    kernel = resample.block_sums

    def watched(m, total, labels):
        assert m.shape[1] <= 700
        return kernel(m, total, labels)

    monkeypatch.setattr(resample, "block_sums", watched)
    sums = resample.drawn_sums(patterns, ("domain",), 20, 2)
    assert sums.where("v0 <> 60000").count() == 0 and sums.count() == 21
    exact = sum(range(20_000)) / 20_000
    assert sums.where(F.abs(F.col("v1") / 60000 - exact) > 5 * 5774 / 60000**0.5).count() == 0


def test_point_values_are_those_of_the_metrics(spark):
    df = nominal(spark, ("x", "y"), 50, 5)
    ac1 = {r.domain: r.ac1 for r in metrics.gwet_ac1_nominal(df).collect()}
    assert {r.domain: pytest.approx(r.value) for r in resample.bootstrap_ac1_ci(df, draws=20).collect()} == ac1


@pytest.mark.parametrize("convention", ["count", "span"])
@pytest.mark.parametrize("group_rows", [None, 10])
def test_bounds_of_groups_of_any_size(spark, convention, group_rows):
    """Ties, null groups, null values and single values, by ranges and one by one."""
    rng = random.Random(1)
    rows = [(g, rng.choice([None, rng.random(), float(rng.randrange(5))])) for g in ["a"] * 500 + ["b"] * 7 + [None] * 90 + ["one"]] + [("one", 2.0), ("ties", 1.0), ("none", None)] + [("ties", 1.0)] * 300
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        if own:
            low, high = resample.percentile_places(len(own), convention)
            want[g] = own[low], own[high], len(own)
    got = resample.percentile_at(df, ["g"], convention, group_rows=group_rows)
    assert {r.g: (r.low, r.high, r.kept) for r in got.collect()} == want


def test_bounds_of_ten_million_rows_in_bounded_tasks(spark):
    """One group, all values different: no task of the range table holds more than a few parts' worth."""
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", "64")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = s.range(10_000_000).select(F.lit("g").alias("g"), ((F.col("id") * 7_919) % 10_000_000).cast("double").alias("value"))
    kept, written = [], resample.written
    resample.written = lambda d, name: kept.append(written(d, name)) or kept[-1]
    try:
        r = resample.percentile_at(df, ["g"], "count").first()
    finally:
        resample.written = written
    assert (r.low, r.high, r.kept) == (250_000.0, 9_749_999.0, 10_000_000)
    assert kept[0].groupBy("part").count().agg(F.max("count")).first()[0] < 3 * 10_000_000 / 64


def test_draws_by_md5_are_never_broadcast_nor_numbered_by_group(spark):
    """Draws are far more rows than what Spark has counted before them; groups, one of them null, fit no single task."""
    rows = [("x" if i % 3 else None, i, f"p{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "domain string, item_id long, pattern string")
    found = resample.md5_draws(df, 3, "s")
    taken = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Window" not in plan
    for d in ("x", None):
        own = [r[1:] for r in rows if r[0] == d]
        want = [(b, i, *own[int(hashlib.md5(f"s|{b}|{i}".encode()).hexdigest()[:8], 16) % len(own)]) for b in range(3) for i in range(len(own))]
        assert sorted((r.draw, r.place, r.item_id, r.pattern) for r in taken if r.domain == d) == sorted(want)


@pytest.mark.parametrize("name", ["consensus", "nominal"])
def test_joined_tables_of_a_label_set_are_not_broadcast(spark, name):
    """Labels and orders grow with the input; what is broadcast must not."""
    plan = fixture(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_draws_by_md5_fold_the_ratings_once(spark, monkeypatch):
    """Patterns and draws read the same written fold: the plan of the draws does not reach back to the ratings."""
    names, write = [], resample.written
    monkeypatch.setattr(resample, "written", lambda df, name: names.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    resample.panel_draws(nominal(spark), "weighted", draws=3, md5_seed="s").collect()
    assert [name for name, plan in names if "LogicalRDD" in plan or "LocalRelation" in plan] == ["item-patterns"]


@pytest.mark.parametrize("how", ["merge", "shuffle_hash"])
def test_groups_share_the_md5_of_a_place(spark, monkeypatch, how):
    """The md5 is taken before places are dealt to groups, in slots of few groups, and both joins draw the same rows."""
    monkeypatch.setattr(resample, "GROUPS", 2)
    rows = [(g, i) for g, n in (("a", 9), ("b", 4), (None, 6), ("c", 1), ("d", 2)) for i in range(n)]
    found = resample.md5_draws(spark.createDataFrame(rows, "domain string, item_id long"), 3, "s", how=how)
    taken = sorted((str(r.domain), r.draw, r.place, r.item_id) for r in found.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    explodes = [i for i, line in enumerate(plan.splitlines()) if "Generate explode" in line]
    assert len(explodes) == 2 and explodes[0] < next(i for i, line in enumerate(plan.splitlines()) if "md5(" in line) < explodes[1]
    assert ("ShuffledHashJoin" if how == "shuffle_hash" else "SortMergeJoin") in found._jdf.queryExecution().executedPlan().toString()
    size = {g: sum(h == g for h, _ in rows) for g, _ in rows}
    want = [(str(g), b, i, int(hashlib.md5(f"s|{b}|{i}".encode()).hexdigest()[:8], 16) % size[g]) for b in range(3) for g, i in rows]
    assert taken == sorted(want)


def test_draws_of_no_rows(spark):
    assert resample.md5_draws(spark.createDataFrame([], "domain string, item_id long"), 3, "s").count() == 0
