"""The intervals once more with draws that SQL can repeat: the same statistics, few draws, all rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelmark.jobs.registry import MATCHES, ac1_sql, matches, panel_sql, query, r6
from panelmark.operators import pairs as pr
from panelmark.operators import reference as rf
from panelmark.operators import resample as rs

DRAWS = 40


def md5_sql(source: str, order: str, key: str = "domain") -> str:
    """(key, draw, place, rows of ``source``): row md5(s|draw|place) mod n of each group."""
    return f"""(WITH m AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS mi, count(*) OVER (PARTITION BY {key}) AS mn FROM {source} src),
 d AS (SELECT {key}, b AS draw, mi AS place, ('0x' || substr(md5(concat('s|', b, '|', mi)), 1, 8))::BIGINT % mn AS mi FROM m CROSS JOIN (SELECT unnest(range(0, {DRAWS})) AS b) b)
 SELECT d.draw, d.place, m.* FROM d JOIN m USING ({key}, mi))"""


def bounds_sql(values: str, keys: str, convention: str) -> str:
    """(keys, low, high, kept) of (keys, value)."""
    low, high = ("floor(n * 0.025::DOUBLE)", "greatest(0, floor(n * 0.975::DOUBLE) - 1)") if convention == "count" else ("floor((n - 1) * 0.025::DOUBLE)", "floor((n - 1) * 0.975::DOUBLE)")
    return f"(SELECT {keys}, max(CASE WHEN i = {low} THEN value END) AS low, max(CASE WHEN i = {high} THEN value END) AS high, max(n) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {values} v WHERE value IS NOT NULL) k GROUP BY {keys})"


def ratio_sql(sums: str, order: str) -> str:
    drawn = f"(SELECT domain, draw, sum(value) / sum(size)::DOUBLE AS value FROM {md5_sql(sums, order)} z GROUP BY domain, draw)"
    return f"SELECT domain, n, units, {r6('mean')} AS mean, {r6('low')} AS low, {r6('high')} AS high, kept FROM (SELECT domain, sum(size)::BIGINT AS n, count(*) AS units, sum(value) / sum(size)::DOUBLE AS mean FROM {sums} s GROUP BY domain) p JOIN {bounds_sql(drawn, 'domain', 'count')} b USING (domain)"


def drawn_labels(source: str, key: str, item: str) -> str:
    """Labels of the items drawn, with draw and place."""
    return f"(SELECT z.{key}, z.draw, z.place, r.label FROM {md5_sql(f'(SELECT DISTINCT {key}, {item} FROM {source} y WHERE label IS NOT NULL)', item, key)} z JOIN {source} r ON z.{key} = r.{key} AND z.{item} = r.{item} WHERE r.label IS NOT NULL)"


def ac1_bounds(source: str, key: str = "domain", item: str = "item_id") -> str:
    values = f"(SELECT {key}, ac1 AS value FROM {ac1_sql(drawn_labels(source, key, item), f'{key}, draw', 'place')} a)"
    return bounds_sql(values, key, "span")


def difference_sql(source: str, key: str, item: str, pairs: str) -> str:
    """Differences of AC1 between the groups of ``pairs`` (a, b), draw by draw."""
    values = f"(SELECT {key} AS g, draw, ac1 FROM {ac1_sql(drawn_labels(source, key, item), f'{key}, draw', 'place')} a)"
    both = f"(SELECT a, b, x.ac1 - y.ac1 AS value FROM {pairs} p JOIN {values} x ON x.g = p.a JOIN {values} y ON y.g = p.b AND y.draw = x.draw)"
    point = f"(SELECT {key} AS g, ac1 FROM {ac1_sql(source, key, item)} a)"
    return f"SELECT a, b, {r6('x.ac1 - y.ac1')} AS difference, {r6('low')} AS low, {r6('high')} AS high, kept, (low > 0 OR high < 0) AS excludes_zero FROM {bounds_sql(both, 'a, b', 'span')} k JOIN {point} x ON x.g = k.a JOIN {point} y ON y.g = k.b"


ONES = f"(SELECT *, 1 AS size FROM {MATCHES} m)"
CLUSTERS = f"(SELECT domain, cluster_id, sum(value) AS value, count(*) AS size FROM {MATCHES} m JOIN [items] i USING (domain, item_id) GROUP BY domain, cluster_id)"


@query("r1_md5_mean_ci", ratio_sql(ONES, "item_id"))
def _(get):  # noqa: ANN001, ANN202
    return rs.md5_ratio_ci(rs.sized(matches(get)), DRAWS, "s")


@query("r2_md5_cluster_ci", ratio_sql(CLUSTERS, "cluster_id"))
def _(get):  # noqa: ANN001, ANN202
    return rs.md5_ratio_ci(rs.cluster_sums(pr.attach_cluster(matches(get), get("items")), "value"), DRAWS, "s", order=("cluster_id",))


@query("r3_md5_ac1_ci", f"SELECT domain, {r6('low')} AS low, {r6('high')} AS high, kept FROM {ac1_bounds('[nominal]')} b")
def _(get):  # noqa: ANN001, ANN202
    return rs.bootstrap_ac1_ci(get("nominal"), draws=DRAWS, md5_seed="s").where("kept > 0").drop("n_items", "value")


WEIGHTS = f"(SELECT domain, draw, avg(w) AS value FROM (SELECT domain, draw, place, CASE WHEN count(DISTINCT label) = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 3 END AS w FROM {drawn_labels('[ratings]', 'domain', 'item_id')} q GROUP BY ALL) i GROUP BY domain, draw)"


@query("r4_md5_panel_ci", f"SELECT domain, {r6('low')} AS low, {r6('high')} AS high, kept FROM {bounds_sql(WEIGHTS, 'domain', 'span')} b")
def _(get):  # noqa: ANN001, ANN202
    return rs.bootstrap_panel_ci(get("ratings"), "weighted", draws=DRAWS, md5_seed="s").where("kept > 0").drop("n_items", "value")


@query("r5_md5_difference_ci", difference_sql("[ratings]", "domain", "item_id", "(SELECT x.lang AS a, y.lang AS b FROM (SELECT DISTINCT lang FROM documents) x JOIN (SELECT DISTINCT lang FROM documents) y ON x.lang < y.lang)"))
def _(get):  # noqa: ANN001, ANN202
    domains = sorted(r.domain for r in get("ratings").where("domain is not null").select("domain").distinct().collect())  # configuration-sized
    return rs.difference_ci(get("ratings"), list(combinations(domains, 2)), draws=DRAWS, md5_seed="s")


COHORTS = "(SELECT concat(domain, '|', round) AS cohort_group, item_id, label FROM [consensus] c)"
COHORT_PAIRS = "(SELECT concat(domain, '|1') AS a, concat(domain, '|2') AS b FROM (SELECT DISTINCT domain FROM [consensus] c) d)"


@query("r6_md5_cohort_shift", f"SELECT * EXCLUDE (a, b), string_split(a, '|')[1] AS \"group\" FROM ({difference_sql(COHORTS, 'cohort_group', 'item_id', COHORT_PAIRS)}) d")
def _(get):  # noqa: ANN001, ANN202
    return rs.cohort_shift(get("consensus").withColumnRenamed("annotator_id", "rater_id"), "round", 1, 2, draws=DRAWS, md5_seed="s")


def side_sql(source: str, name: str) -> str:
    return f"(SELECT a.domain, n_items AS {name}_items, ac1 AS {name}_ac1, low AS {name}_low, high AS {name}_high, kept AS {name}_kept FROM {ac1_sql(source)} a LEFT JOIN {ac1_bounds(source)} b ON a.domain = b.domain)"


@query("a34_md5_reliability_table", f"""SELECT h.domain, human_items, {r6('human_ac1')} AS human_ac1, {r6('human_low')} AS human_low, {r6('human_high')} AS human_high, human_kept, system_items, {r6('system_ac1')} AS system_ac1, {r6('system_low')} AS system_low, {r6('system_high')} AS system_high, system_kept,
 {r6('weighted')} AS system_a, {r6('all_agree')} AS system_unanimous, rank() OVER (ORDER BY human_ac1 DESC) AS human_rank, rank() OVER (ORDER BY system_ac1 DESC) AS system_rank
 FROM {side_sql('[consensus]', 'human')} h JOIN {side_sql('[ratings]', 'system')} s ON h.domain = s.domain JOIN {panel_sql('[ratings]', w='(2.0::DOUBLE / 3)')} p ON p.domain = h.domain""")
def _(get):  # noqa: ANN001, ANN202
    found = rf.reliability_table(get("consensus").withColumnRenamed("annotator_id", "rater_id"), get("ratings"), draws=DRAWS, md5_seed="s")
    return found.withColumns({c: F.nullif(c, F.lit(0)) for c in ("human_kept", "system_kept")})  # SQL has no row of a group without defined draws
