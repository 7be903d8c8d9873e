"""Last writes and pattern tables of streams; subsets of raters by bit masks."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.operators import metrics, raters
from panelmark.streaming import intake

CALLS = "k string, ts timestamp, seq int, label string"


def arrive(spark, folder, rows):
    """One file of rows (k, minute, seq, label)."""
    df = spark.createDataFrame(rows, "k string, m int, seq int, label string")
    df.select("k", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60).alias("ts"), "seq", "label").coalesce(1).write.mode("append").parquet(folder)


def test_the_last_write_inside_the_delay_wins(spark, tmp_path):
    folder, log = f"{tmp_path}/in", f"{tmp_path}/log"

    def step(rows):
        arrive(spark, folder, rows)
        query = intake.stream_latest(spark.readStream.schema(CALLS).parquet(folder), log, f"{tmp_path}/cp", ("k",), "ts", "30 minutes", "seq")
        query.awaitTermination()
        kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        return sorted((r.k or "", r.seq, r.label) for r in spark.read.schema(CALLS).parquet(log).collect()), kept[-1]

    before = spark.conf.get(intake.STORE[0], None)
    got, state = step([("a", 0, 1, "LOW"), ("b", 1, 2, "LOW"), (None, 2, 3, "LOW"), ("a", 0, 1, "HIGH")])
    assert got == [] and state > 0  # all wait for corrections
    held = state
    got, state = step([("a", 10, 4, "HIGH"), ("b", 1, 5, None), ("b", 0, 6, "HIGH")])
    assert got == [] and state == held  # corrections replace, they do not pile up
    got, state = step([("c", 35, 7, "LOW")])  # watermark: minute 5
    assert got == [("", 3, "LOW"), ("b", 5, None)]  # of one minute the larger sequence, not the later arrival of an older time
    got, state = step([("b", 3, 8, "LOW"), ("d", 100, 9, "LOW")])  # b is behind the watermark; then minute 70
    assert got == [("", 3, "LOW"), ("a", 4, "HIGH"), ("b", 5, None), ("c", 7, "LOW")]
    assert state < held  # only d is left
    assert spark.conf.get(intake.STORE[0], None) == before


def test_pattern_table_follows_items_that_move(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["d", "e", None]), rng.randrange(40), f"r{i % 7}", rng.choice(["HIGH", "LOW", None, "odd"])) for i in range(600)]
    schema = "domain string, item_id long, rater_id string, label string"
    sink = intake.PatternTable(f"{tmp_path}/patterns", compact_every=3)
    seen = []
    for i in range(0, 600, 120):
        spark.createDataFrame(rows[i : i + 120], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        intake.stream_panel_patterns(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/cp").awaitTermination()
        want = metrics.panel_metrics(spark.createDataFrame(rows[: i + 120], schema))
        rounded = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
        assert rounded(sink.metrics(spark)) == rounded(want)
        seen.append(sink.additions(spark).count())
    patterns = sink.patterns(spark).count()
    assert sum(r["items"] for r in sink.patterns(spark).collect()) == len({r[:2] for r in rows if r[3] in ("HIGH", "LOW")})
    assert seen[-1] < 3 * 3 * patterns  # the base and at most two batches of -1 and +1, whatever the number of votes
    # A replayed batch, and one that the base holds already, change nothing.
    base, batches = sink._parts(spark)
    before = sorted(map(str, sink.patterns(spark).collect()))
    sink(spark.createDataFrame(spark.read.parquet(f"{tmp_path}/patterns/batch-{batches[-1]}").collect(), "domain string, n long, h long, items long"), batches[-1])
    sink(spark.createDataFrame([("d", 1, 1, 99)], "domain string, n long, h long, items long"), base)
    assert sorted(map(str, sink.patterns(spark).collect())) == before


def test_state_of_the_pattern_stream_is_kept_by_buckets(spark, tmp_path):
    """Values of the state are bounded by the buckets of each group, not by the items."""
    schema = "domain string, item_id long, rater_id string, label string"
    rows = [("d" if i % 2 else None, i // 2, r, "HIGH" if i % 3 else "LOW") for i in range(400) for r in ("a", "b")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    sink = intake.PatternTable(f"{tmp_path}/patterns")
    query = intake.stream_panel_patterns(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/cp", buckets=8)
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 16
    assert {(r.domain, r.n, r.h): r["items"] for r in sink.patterns(spark).collect()} == Counter((d, 2, 2 * (label == "HIGH")) for d, _, r, label in rows if r == "a")


def test_superset_sums_against_all_subsets():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 8):
        present, high, items = rng.integers(0, 1 << size, 60), rng.integers(0, 1 << size, 60), rng.integers(1, 5, 60)
        want = Counter()
        for p, h, n in zip(present.tolist(), high.tolist(), items.tolist(), strict=True):
            for s in range(1 << size):
                if s & p == s:
                    want[s, (h & s).bit_count()] += n
        subset, votes, n = raters.superset_sums(present, high, items, size)
        assert dict(zip(zip(subset.tolist(), votes.tolist(), strict=True), n.tolist(), strict=True)) == want


@pytest.mark.parametrize("block", [4096, 8])
def test_sweep_of_sixteen_raters(spark, monkeypatch, block):
    """All 65,519 subsets of two raters or more, against direct counting of some hundred of them; in one block and many."""
    monkeypatch.setattr(raters, "PATTERN_BLOCK", block)
    rng = random.Random(block)
    names = [f"r{i:02d}" for i in range(16)]
    rows = [("d" if i % 3 else None, i, r, rng.choice(["HIGH", "LOW"])) for i in range(40) for r in names if rng.random() < 0.93]
    df = spark.createDataFrame([*rows, ("d", 1, "other", "HIGH"), ("d", 1, names[0], None)], "domain string, item_id long, rater_id string, label string")
    got = raters.panel_subset_sweep(df, names)
    assert got.groupBy("domain").count().where("count > 65519").count() == 0
    found = {(r.domain, r.subset): (r.k, r.n, round(r.a, 9)) for r in got.collect()}
    items = {}
    for d, i, r, label in rows:
        items.setdefault((d, i), {})[r] = label
    pairs = [*itertools.combinations(names, 2), *(tuple(sorted(rng.sample(names, k))) for k in range(3, 17) for _ in range(8))]
    for d in ("d", None):
        for s in pairs:
            own = [[x[r] for r in s] for (g, _), x in items.items() if g == d and all(r in x for r in s)]
            want = (len(s), len(own), round(sum(max(x.count("HIGH"), x.count("LOW")) for x in own) / (len(own) * len(s)), 9)) if own else None
            assert found.get((d, "+".join(s))) == want
    best = got.where("domain = 'd'").orderBy("rank_a", "subset").first()
    assert best.rank_a == 1 and best.a == got.where("domain = 'd'").agg(F.max("a")).first()[0]
    with pytest.raises(ValueError, match="at most"):
        raters.panel_subset_sweep(df, [str(i) for i in range(21)])


def test_pairs_of_an_item_with_many_raters(spark, monkeypatch):
    """Blocks of three against all pairs counted directly; then one item of 5000 raters."""
    monkeypatch.setattr(raters, "PAIR_BLOCK", 3)
    rng = random.Random(9)
    rows = [(d, i, f"r{k:02d}", rng.choice(["HIGH", "LOW", None])) for d in ("d", None) for i in range(12) for k in range(rng.randint(0, 14))]
    got = raters.rater_pair_matrix(spark.createDataFrame(rows, "domain string, item_id long, rater_id string, label string"))
    want = {}
    items = {}
    for d, i, r, label in rows:
        if label:
            items.setdefault((d, i), {})[r] = label
    for (d, _), own in items.items():
        for a, b in itertools.combinations(sorted(own), 2):
            n, same = want.get((d, a, b), (0, 0))
            want[d, a, b] = n + 1, same + (own[a] == own[b])
    assert {(r.domain, r.rater_a, r.rater_b): (r.n, round(r.agreement * r.n)) for r in got.collect()} == want
    monkeypatch.setattr(raters, "PAIR_BLOCK", 64)
    many = spark.range(5000).select(F.lit("d").alias("domain"), F.lit(1).alias("item_id"), F.format_string("r%04d", "id").alias("rater_id"), F.when(F.col("id") % 3 == 0, "HIGH").otherwise("LOW").alias("label"))
    r = raters.rater_pair_matrix(many).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("n") * F.col("agreement")).alias("same")).first()
    assert r.pairs == 5000 * 4999 // 2 and round(r.same) == 1667 * 1666 // 2 + 3333 * 3332 // 2


def test_merged_sketches_keep_their_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 2).cast("string").alias("corpus"), (F.col("id") % 9).alias("batch"), (F.col("id") % 60_000).cast("string").alias("cluster_id"))
    for r in raters.merged_coverage(raters.cluster_sketches(rows, ("corpus", "batch"))).collect():
        assert r["items"] == 100_000 and abs(r.clusters - 30_000) < 4 * 0.0065 * 30_000
    assert raters.merged_coverage(raters.cluster_sketches(rows.limit(0), ("corpus",))).count() == 0
