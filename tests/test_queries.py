"""Registered queries against DuckDB on the smallest tables."""

import pytest
from conftest import rows_of

from panelmark.jobs import queries, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    result = duck.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    want = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.collect(), columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", ["r1_bootstrap_mean_ci", "r5_difference_ci"])
def test_intervals_hold_their_value_and_rerun_alike(spark, name):
    one = queries.QUERIES[name](spark, FOLDER).collect()
    assert one and sorted(map(str, one)) == sorted(map(str, queries.QUERIES[name](spark, FOLDER).collect()))
    value = "mean" if "mean" in one[0] else "difference"
    assert all(r.low <= r[value] <= r.high for r in one)


def test_differences_of_all_pairs_of_domains(spark):
    domains = sorted(r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang").distinct().collect())
    got = queries.QUERIES["r5_difference_ci"](spark, FOLDER).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in domains for b in domains if a < b]


@pytest.mark.parametrize("name", ["r3_bootstrap_ac1_ci", "r4_bootstrap_panel_ci", "r5_difference_ci", "r6_cohort_shift", "a34_reliability_table"])
def test_intervals_come_from_all_draws(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).collect()
    assert max(r[c] for r in got for c in got[0].asDict() if c.endswith("kept")) == 10_000


def test_cluster_intervals_take_the_default_of_draws(spark):
    from panelmark.operators import pairs as pr
    from panelmark.operators import resample as rs

    get = lambda x: registry.fixture(spark, FOLDER, x)
    want = registry.rounded(rs.both_cis(pr.attach_cluster(registry.matches(get), get("items")), "value", draws=10_000))
    assert sorted(map(str, queries.QUERIES["r2_cluster_bootstrap_ci"](spark, FOLDER).collect())) == sorted(map(str, want.collect()))
