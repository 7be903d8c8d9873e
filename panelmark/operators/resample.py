"""Bootstrap intervals.

Resampling items with replacement is a multinomial draw over the distinct item patterns, so B draws cost B times the
number of patterns, whatever the number of items.  Spark counts the patterns and numpy draws them.

There may be as many patterns as there are clusters, or as items of many raters.  They are dealt to blocks of about
``BLOCK``; a draw first splits the group's total among the blocks (every task of a group repeats that split from the
group's own random stream) and then each block's part among its patterns, which together is the same multinomial draw.  A
task holds one block.  Every statistic is a function of sums of vectors (``ratio_patterns``, ``panel_vectors``), so sums
per draw are added in Spark and the statistic is taken from them.

``md5_*`` functions draw rows by md5 instead, n of n for each draw: for small tables, and so that any SQL engine can
repeat a result.  Their draws go through the same kernel and the same statistics.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.operators.keys import joined, unused
from panelmark.operators.metrics import item_patterns, label_patterns, ratio
from panelmark.operators.votes import ITEM, with_row_index
from panelmark.sources.shared import written

#: Draws that one task holds at once; patterns of a block; labels that are summed at once.
CHUNK, BLOCK, LABELS = 500, 4096, 256
#: Values of a group that are sorted in one task.
SORTED_ROWS = 1_000_000
#: Rows drawn by md5 that one task makes and joins: at most, and at least where there are fewer than one each core could have.
DRAWN_ROWS, LEAST_ROWS = 4_000_000, 250_000
#: Rows that a task holds to look up draws; groups whose places are drawn by the same md5 at once.
HELD_ROWS, GROUPS = 400_000, 256


def percentile_places(n: int, convention: str, low: float = 0.025, high: float = 0.975) -> tuple[int, int]:
    """Zero-based places of the bounds among n sorted draws.  ``count``: int(low n) and int(high n) - 1; ``span``:
    int(q (n - 1))."""
    if convention == "count":
        return int(low * n), max(0, int(high * n) - 1)
    if convention == "span":
        return int(low * (n - 1)), int(high * (n - 1))
    raise ValueError(f"unknown convention {convention!r}")


def _bounds(n: Column, convention: str) -> tuple[Column, Column]:
    """Zero-based places of both bounds among n sorted values."""
    if convention == "count":
        return F.floor(n * F.lit(0.025)), F.greatest(F.lit(0), F.floor(n * F.lit(0.975)) - 1)
    if convention == "span":
        return F.floor((n - 1) * F.lit(0.025)), F.floor((n - 1) * F.lit(0.975))
    raise ValueError(f"unknown convention {convention!r}")


def percentile_at(draws: DataFrame, keys, convention: str, value: str = "value", group_rows: int | None = None) -> DataFrame:
    """(keys, low, high, kept): bounds per group of a table of values, by position, as the conventions say.

    Equal values of a group are counted first.  Groups of known size (``group_rows``, the draws of a bootstrap) up to
    ``SORTED_ROWS`` are sorted one by one.  Groups of any size are dealt by ranges of (group, value) and written with their
    task's number; counts per task and group then tell in which task a bound lies, and only there values are put in
    order, so no task holds more than its range."""
    keys = list(keys)
    counted = draws.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    if group_rows is not None and group_rows <= SORTED_ROWS:
        return _sorted_groups(counted, keys, convention)
    dealt = counted.repartitionByRange(*keys, "value")
    return _range_bounds(written(dealt.withColumn("part", F.spark_partition_id()), "value-ranges"), keys, convention)


def _sorted_groups(counted: DataFrame, keys: list[str], convention: str) -> DataFrame:
    group = W.partitionBy(*keys)
    ranked = counted.withColumns({"upto": F.sum("c").over(group.orderBy("value")), "n": F.sum("c").over(group)})
    low, high = _bounds(F.col("n"), convention)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    return ranked.groupBy(*keys).agg(at(low).alias("low"), at(high).alias("high"), F.max("n").alias("kept"))


def _range_bounds(placed: DataFrame, keys: list[str], convention: str) -> DataFrame:
    """Bounds of (keys, value, c, part), where parts are ranges of (keys, value) in order."""
    counts = placed.groupBy(*keys, "part").agg(F.sum("c").alias("c"))
    group = W.partitionBy(*keys)  # a row per task that holds values of the group
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = counts.withColumns({"before": before, "n": F.sum("c").over(group)})
    low, high = _bounds(F.col("n"), convention)
    holds = lambda place: (place >= F.col("before")) & (place < F.col("before") + F.col("c"))
    asked = known.withColumns({"low_at": F.when(holds(low), low - F.col("before")), "high_at": F.when(holds(high), high - F.col("before"))})
    asked = asked.where("low_at is not null or high_at is not null").select(*keys, "part", "low_at", "high_at", "n")
    there = joined(placed, asked, [*keys, "part"])
    upto = F.sum("c").over(W.partitionBy(*keys, "part").orderBy("value"))
    ranked = there.withColumn("upto", upto)
    at = lambda place: F.min(F.when(F.col("upto") > F.col(place), F.col("value")))
    return ranked.groupBy(*keys).agg(at("low_at").alias("low"), at("high_at").alias("high"), F.max("n").alias("kept"))


def _stream(seed: int, *names) -> np.random.Generator:
    """Each group and chunk has its own random stream."""
    return np.random.default_rng([seed, *(zlib.crc32(str(n).encode()) for n in names)])


def multinomial_rows(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    return rng.multinomial(int(counts.sum()), counts / counts.sum(), size=draws)


def _types(df: DataFrame, keys) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def block_sums(m: np.ndarray, total: np.ndarray, labels: list[list[tuple]]) -> tuple[np.ndarray, list, np.ndarray]:
    """Sums of drawn patterns: m is draws x patterns, ``total`` patterns x values, ``labels`` the (label, values) of each
    pattern.  Gives draws x values, the labels seen, and labels x draws x values."""
    names = sorted({x[0] for own in labels for x in own}, key=str)
    at = {x: i for i, x in enumerate(names)}
    width = len(labels[0][0][1]) if names else 0
    by_label = np.zeros((len(names), len(m), width))
    for i in range(0, len(names), LABELS):  # so many labels at once, whatever a block holds
        chosen = names[i : i + LABELS]
        cells = np.zeros((len(labels), len(chosen), width))
        for row, own in enumerate(labels):
            for label, values in own:
                if i <= at[label] < i + LABELS:
                    cells[row, at[label] - i] = values
        by_label[i : i + len(chosen)] = (m @ cells.reshape(len(labels), -1)).reshape(len(m), len(chosen), width).transpose(1, 0, 2)
    return m @ total, names, by_label


def drawn_sums(patterns: DataFrame, keys, draws: int, width: int, seed: int = 0, drawn: DataFrame | None = None) -> DataFrame:
    """(keys, draw, is_total, label, v0, v1, ...): sums of the patterns' vectors over resampled items, and over the items
    themselves as draw -1.

    ``patterns``: (keys, pattern string, items, total array<double>, labels array<struct<label, v array<double>>>), with
    vectors of up to ``width`` values.
    Patterns are dealt to blocks of about ``BLOCK``.  A draw splits the group's items among the blocks (each task repeats
    that split from the group's own stream), and a block's part among its patterns: together the same multinomial draw.
    Sums of the blocks are added in Spark.  ``drawn`` (keys, draw, pattern, m) gives the draws instead, so that the same
    kernel can be held against draws that SQL repeats."""
    keys = list(keys)
    patterns = written(patterns.select(*keys, "pattern", F.col("items").cast("long"), "total", "labels"), "patterns")  # read three times
    blocks = patterns.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    dealt = joined(patterns, blocks, keys).withColumn("block", F.pmod(F.xxhash64("pattern"), F.col("n_blocks")).cast("int")).drop("n_blocks")
    totals = dealt.groupBy(*keys, "block").agg(F.sum("items").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("totals"))
    group, given = [*keys, "block"], drawn is not None
    per_block = joined(dealt.select(*group).distinct(), totals, keys).select(*group, "totals", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("long").alias("draw"), F.lit(None).cast("long").alias("m"))
    if given:
        placed = joined(drawn.select(*keys, "pattern", "draw", "m"), dealt.select(*group, "pattern"), [*keys, "pattern"])
        per_block = per_block.unionByName(placed.select(*group, F.lit(None).cast(per_block.schema["totals"].dataType).alias("totals"), "pattern", F.col("draw").cast("long").alias("draw"), F.col("m").cast("long").alias("m")))
    label_type = patterns.schema["labels"].dataType.elementType["label"].dataType.simpleString()
    values = [f"v{i}" for i in range(width)]

    def run(key, left: pd.DataFrame, right: pd.DataFrame):  # noqa: ANN001, ANN202
        left = left.sort_values("pattern", ignore_index=True)
        items, total = left["items"].to_numpy(), np.stack(left["total"].to_list())
        labels = [[(x["label"], x["v"]) for x in own] for own in left["labels"]]

        def rows(m: np.ndarray, start: int) -> pd.DataFrame:
            sums, names, by_label = block_sums(m.astype(float), total, labels)
            parts = []
            for is_total, label, found in [(True, None, sums), *((False, x, by_label[i]) for i, x in enumerate(names))]:
                head = {k: [x] * len(m) for k, x in zip(keys, key, strict=False)}
                wide = np.full((len(m), width), np.nan)
                wide[:, : found.shape[1]] = found
                parts.append(pd.DataFrame({**head, "draw": np.arange(start, start + len(m)), "is_total": is_total, "label": [label] * len(m), **{v: wide[:, i] for i, v in enumerate(values)}}))
            return pd.concat(parts, ignore_index=True)

        out = [rows(items[None, :], -1)]
        if given:
            asked = right[right["pattern"].notna()]
            place = {p: i for i, p in enumerate(left["pattern"])}
            for start in range(0, draws, CHUNK):
                some = asked[(asked["draw"] >= start) & (asked["draw"] < start + CHUNK)]
                m = np.zeros((min(CHUNK, draws - start), len(items)))
                m[(some["draw"] - start).astype(int), some["pattern"].map(place).astype(int)] = some["m"]
                out.append(rows(m, start))
            return pd.concat(out, ignore_index=True)
        split = next(x for x in right["totals"] if x is not None)
        at = [int(x["block"]) for x in split].index(int(key[-1]))
        n = np.array([int(x["n"]) for x in split])
        top, own = _stream(seed, *key[:-1]), _stream(seed, *key)
        for start in range(0, draws, CHUNK):
            size = multinomial_rows(top, n, min(CHUNK, draws - start))[:, at]
            out.append(rows(own.multinomial(size, items / items.sum()), start))
        return pd.concat(out, ignore_index=True)

    right_names = [F.col(c).alias(f"{c}__block") for c in group]
    right = per_block.select(*right_names, "totals", "pattern", "draw", "m")
    schema = f"{_types(patterns, keys)}, draw long, is_total boolean, label {label_type}, " + ", ".join(f"{v} double" for v in values)
    sums = dealt.groupBy(*group).cogroup(right.groupBy(*(f"{c}__block" for c in group))).applyInPandas(run, schema)
    return sums.groupBy(*keys, "draw", "is_total", "label").agg(*(F.sum(v).alias(v) for v in values))


def ratio_patterns(histogram: DataFrame, keys) -> DataFrame:
    """Patterns of a histogram (keys, value, size, items)."""
    name = F.concat_ws("|", F.col("value").cast("string"), F.col("size").cast("string"))
    none = F.array().cast("array<struct<label:string,v:array<double>>>")
    return histogram.select(*keys, name.alias("pattern"), "items", F.array(F.col("value").cast("double"), F.col("size").cast("double"), F.lit(1.0)).alias("total"), none.alias("labels"))


def ratio_draws(histogram: DataFrame, keys, draws: int, seed: int) -> DataFrame:
    """(keys, draw, value): ratios of the resampled sums of ``value`` and ``size`` from a histogram (keys, value, size,
    items)."""
    sums = drawn_sums(ratio_patterns(histogram, keys), keys, draws, 3, seed)
    return sums.where("draw >= 0").select(*keys, "draw", ratio(F.col("v0"), F.col("v1")).alias("value"))


def intervals(values: DataFrame, keys, convention: str, draws: int, point) -> DataFrame:
    """(keys, point, low, high, kept) of (keys, draw, value, point): ``point`` columns as draw -1 has them.  A group's draws
    are as many as the caller asked for, so they are put in order as one array; more than ``SORTED_ROWS`` go by ranges."""
    keys = list(keys)
    own = [F.max(F.when(F.col("draw") < 0, F.col(c))).alias(c) for c in point]
    drawn = F.col("draw") >= 0
    if draws > SORTED_ROWS:
        values = written(values, "draw-values")
        return joined(values.groupBy(*keys).agg(*own), percentile_at(values.where(drawn), keys, convention), keys, "left").fillna(0, ["kept"])
    folded = values.groupBy(*keys).agg(*own, F.sort_array(F.collect_list(F.when(drawn, F.col("value")))).alias("drawn_values"))
    n = F.size("drawn_values")
    low, high = (F.get("drawn_values", place.cast("int")) for place in _bounds(n, convention))
    some = n > 0
    return folded.select(*keys, *point, F.when(some, low).alias("low"), F.when(some, high).alias("high"), n.cast("long").alias("kept"))


def _ratio_ci(histogram: DataFrame, keys, draws: int, seed: int, convention: str, drawn: DataFrame | None = None) -> DataFrame:
    sums = drawn_sums(ratio_patterns(histogram, keys), keys, draws, 3, seed, drawn)
    value = ratio(F.col("v0"), F.col("v1"))
    values = sums.select(*keys, "draw", value.alias("value"), F.round("v1").cast("long").alias("n"), F.round("v2").cast("long").alias("units"), value.alias("mean"))
    return intervals(values, keys, convention, draws, ("n", "units", "mean"))


def bootstrap_mean_ci(df: DataFrame, value: str, keys=("domain",), draws: int = 10_000, seed: int = 0, convention: str = "count") -> DataFrame:
    """n, units, mean, low, high, kept per group: percentile interval of a mean (matches, paired differences).  The
    histogram of the values is what travels."""
    histogram = df.where(F.col(value).isNotNull()).groupBy(*keys, F.round(F.col(value).cast("double"), 12).alias("value")).agg(F.count(F.lit(1)).alias("items")).withColumn("size", F.lit(1).cast("long"))
    return _ratio_ci(histogram, keys, draws, seed, convention)


def cluster_sums(df: DataFrame, value: str, cluster: str = "cluster_id", keys=("domain",)) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(F.col(value).cast("double")).alias("value"), F.count(F.lit(1)).alias("size"))


def cluster_bootstrap_ci(df: DataFrame, value: str, cluster: str = "cluster_id", keys=("domain",), draws: int = 10_000, seed: int = 0, convention: str = "count") -> DataFrame:
    """As above with whole clusters resampled: the ratio of sums over the clusters drawn.  ``units`` are clusters."""
    histogram = cluster_sums(df, value, cluster, keys).groupBy(*keys, F.round("value", 12).alias("value"), "size").agg(F.count(F.lit(1)).alias("items"))
    return _ratio_ci(histogram, keys, draws, seed, convention)


def both_cis(df: DataFrame, value: str, cluster: str = "cluster_id", keys=("domain",), draws: int = 10_000, seed: int = 0) -> DataFrame:
    """Item and cluster intervals side by side, per group and over all (key ``(all)``), with their widths."""
    every = df.unionByName(df.withColumn(keys[0], F.lit("(all)")))
    item = bootstrap_mean_ci(every, value, keys, draws, seed).select(*keys, "n", "mean", F.col("low").alias("item_low"), F.col("high").alias("item_high"))
    whole = cluster_bootstrap_ci(every, value, cluster, keys, draws, seed).select(*keys, F.col("units").alias("clusters"), F.col("low").alias("cluster_low"), F.col("high").alias("cluster_high"))
    out = item.join(whole, list(keys))
    return out.withColumns({"item_width": F.col("item_high") - F.col("item_low"), "cluster_width": F.col("cluster_high") - F.col("cluster_low")})


#: Panel statistics as functions of sums over items.
STATISTICS = ("gwet_ac1_nominal", "weighted", "all_agree", "pairwise", "fleiss_kappa", "gwet_ac1")


def panel_vectors(patterns: DataFrame, keys) -> DataFrame:
    """``label_patterns`` as patterns of ``drawn_sums``.  Total: items, items of two labels or more, their observed
    agreement, weight, unanimous, agreeing pairs, pairs, labels; per label: its share in items of two or more, such items
    that have it, its count."""
    n = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x.c).cast("double")
    agreeing = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x.c * (x.c - 1)).cast("double")
    ok = F.when(n >= 2, 1.0).otherwise(0.0)
    one = F.size("own") == 1
    total = F.array(F.lit(1.0), ok, F.coalesce(ratio(agreeing, n * (n - 1)), F.lit(0.0)), F.when(one, 1.0).otherwise(2 / 3), F.when(one, 1.0).otherwise(0.0), agreeing, n * (n - 1), n)
    labels = F.transform("own", lambda x: F.struct(x.label.alias("label"), F.array(ok * x.c.cast("double") / n, ok, x.c.cast("double")).alias("v")))
    return patterns.withColumnRenamed("pattern", "own").select(*keys, F.to_json(F.struct(F.col("own").alias("pattern"))).alias("pattern"), "items", total.alias("total"), labels.alias("labels"))


def panel_values(sums: DataFrame, keys, statistic: str) -> DataFrame:
    """(keys, draw, n_items, value) of a panel statistic, from ``drawn_sums`` of ``panel_vectors``.  Null where it is
    undefined: fewer than two categories among the items drawn, or a chance agreement of 1."""
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic {statistic!r}")
    at = lambda i: F.max(F.when(F.col("is_total"), F.col(f"v{i}")))
    by_label = lambda c: F.sum(F.when(~F.col("is_total"), c))
    s0, s2 = F.col("v0"), F.col("v2")
    names = ("items", "ok", "po", "weight", "same", "agreeing", "pairs", "labels")
    folded = sums.groupBy(*keys, "draw").agg(
        *(at(i).alias(f"t_{x}") for i, x in enumerate(names)),
        by_label(s0).alias("s1"),
        by_label(s0 * s0).alias("s2"),
        by_label(F.when(F.col("v1") > 0, 1).otherwise(0)).alias("q"),
        by_label(s2 * s2).alias("c2"),
        by_label(F.lit(1)).alias("known"),
    )
    t = {x: F.col(f"t_{x}") for x in names}
    p2 = ratio(F.col("c2"), t["labels"] * t["labels"])
    po, pairwise = ratio(t["po"], t["ok"]), ratio(t["agreeing"], t["pairs"])
    chance = {
        "gwet_ac1_nominal": (F.col("s1") / t["ok"] - F.col("s2") / (t["ok"] * t["ok"])) / (F.col("q") - 1),
        "fleiss_kappa": p2,
        "gwet_ac1": (1 - p2) / F.greatest(F.col("known") - 1, F.lit(1)),
    }
    if statistic in chance:
        pe, agreed = chance[statistic], po if statistic == "gwet_ac1_nominal" else pairwise
        value = F.when(F.abs(1 - pe) > 1e-8, (agreed - pe) / (1 - pe))
        if statistic == "gwet_ac1_nominal":
            value = F.when((F.col("q") >= 2) & (t["ok"] > 0), value)
    else:
        value = {"weighted": ratio(t["weight"], t["items"]), "all_agree": ratio(t["same"], t["items"]), "pairwise": pairwise}[statistic]
    return folded.select(*keys, "draw", t["items"].cast("long").alias("n_items"), value.alias("value"))


def panel_draws(ratings: DataFrame, statistic: str, keys=("domain",), draws: int = 10_000, seed: int = 0, item=ITEM, md5_seed: str | None = None) -> DataFrame:
    """(keys, draw, n_items, value) of a panel statistic over resampled items; draw -1 are the items themselves.  With
    ``md5_seed`` the items drawn are those of ``md5_draws``; all that follows is the same."""
    if md5_seed is None:
        patterns, drawn = label_patterns(ratings, keys, item), None
    else:
        folded = written(item_patterns(ratings, keys, item), "item-patterns")  # read by both
        patterns = folded.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("items"))
        drawn = md5_pattern_counts(folded, draws, md5_seed, keys, item)
    return panel_values(drawn_sums(panel_vectors(patterns, keys), keys, draws, 8, seed, drawn), keys, statistic)


def bootstrap_panel_ci(ratings: DataFrame, statistic: str, keys=("domain",), draws: int = 10_000, seed: int = 0, convention: str = "span", item=ITEM, md5_seed: str | None = None) -> DataFrame:
    """n_items, value, low, high, kept per group for any panel statistic.  Undefined draws are dropped and ``kept`` says
    how many were not; a group without any has null bounds."""
    values = panel_draws(ratings, statistic, keys, draws, seed, item, md5_seed)
    return intervals(values.withColumn("point", F.col("value")), keys, convention, draws, ("n_items", "point")).withColumnRenamed("point", "value")


def bootstrap_ac1_ci(ratings: DataFrame, keys=("domain",), draws: int = 10_000, seed: int = 0, item=ITEM, md5_seed: str | None = None) -> DataFrame:
    return bootstrap_panel_ci(ratings, "gwet_ac1_nominal", keys, draws, seed, "span", item, md5_seed)


def difference_ci(ratings: DataFrame, pairs: list[tuple], group: str = "domain", draws: int = 10_000, seed: int = 0, item=ITEM, md5_seed: str | None = None) -> DataFrame:
    """(a, b, difference, low, high, kept, excludes_zero) of AC1 between independent groups: draws pair in draw order.
    With ``md5_seed`` the items drawn are those of ``md5_draws``."""
    spark = ratings.sparkSession
    kind = dict(ratings.dtypes)[group]
    wanted = spark.createDataFrame(pairs, f"a {kind}, b {kind}")
    d = written(panel_draws(ratings, "gwet_ac1_nominal", (group,), draws, seed, item, md5_seed), "draw-values")
    first, second = (d.select(F.col(group).alias(x), "draw", F.col("value").alias(f"v{x}")) for x in "ab")
    both = first.join(wanted, "a").join(second, ["b", "draw"]).withColumn("value", F.col("va") - F.col("vb"))
    bounds = percentile_at(both.where("draw >= 0"), ["a", "b"], "span", group_rows=draws)
    out = bounds.join(both.where("draw < 0").select("a", "b", F.col("value").alias("difference")), ["a", "b"])
    return out.select("a", "b", "difference", "low", "high", "kept", ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"))


def cohort_shift(ratings: DataFrame, cohort: str, first, second, keys=("domain",), draws: int = 10_000, seed: int = 0, item=ITEM, md5_seed: str | None = None) -> DataFrame:  # noqa: ANN001
    """AC1 difference of two disjoint cohorts within each group: its keys, joined by bars, as ``group``."""
    key = F.to_json(F.array(*(F.col(k).cast("string") for k in keys)), {"ignoreNullFields": "false"})
    tagged = ratings.where(F.col(cohort).isin(first, second)).withColumns({"cohort_key": key, "cohort_group": F.concat(key, F.when(F.col(cohort) == first, "1").otherwise("2"))})
    groups = [r[0] for r in tagged.select("cohort_key").distinct().collect()]  # one per group
    pairs = [(f"{g}1", f"{g}2") for g in groups]
    out = difference_ci(tagged, pairs, "cohort_group", draws, seed, item=("cohort_group", *[c for c in item if c not in keys]), md5_seed=md5_seed)
    names = F.from_json(F.expr("left(a, length(a) - 1)"), "array<string>")
    return out.withColumn("group", F.array_join(names, "|")).drop("a", "b")


def md5_draws(df: DataFrame, draws: int, seed: str, keys=("domain",), order=("item_id",), how: str = "merge") -> DataFrame:
    """(keys, draw, place, row): draw b takes for its i-th place the row md5(seed|b|i) mod n, rows in the given order.
    Any SQL engine repeats it; for small n, to hold the fast helpers against.

    Rows are numbered over all groups in order of (keys, ``order``), so that no group has to fit one task, and a draw
    travels as two numbers: itself and the row's.  Groups with a place of the same number share its md5, ``GROUPS`` of them
    in a row.  Draws are ``draws`` times the rows that Spark counts on their way here, so they must never be broadcast and
    are dealt to as many tasks as they need.  ``how`` joins them to the rows: "merge" sorts the draws, "shuffle_hash" holds
    a task's rows instead, ``HELD_ROWS`` at most."""
    number, first, size, draw, place, at, slot, here, hash_ = (unused(df, c) for c in ("row_number", "first_row", "row_count", "draw", "place", "row_at", "slot", "groups_here", "place_hash"))
    rows = with_row_index(df, order=[*keys, *order], name=number)
    rows = written(rows, "numbered-rows")  # read three times
    groups = rows.groupBy(*keys).agg(F.min(number).alias(first), F.count(F.lit(1)).alias(size))
    n_rows, n_groups = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    total = n_rows * draws
    tasks = max(1, -(-total // DRAWN_ROWS), -(-n_rows // HELD_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, total // LEAST_ROWS))
    by_slot = F.pmod(F.xxhash64(first), F.lit(-(-n_groups // GROUPS) or 1)).alias(slot)
    places = joined(rows.select(*keys, number), F.broadcast(groups), keys).select((F.col(number) - F.col(first)).alias(place), by_slot, first, size)
    shared = places.repartition(tasks, place).groupBy(place, slot).agg(F.collect_list(F.struct(first, size)).alias(here))
    each = shared.select(place, here, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias(draw))
    index = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(draw).cast("string"), F.col(place).cast("string"))), 1, 8), 16, 10).cast("long")
    hashed = each.withColumn(hash_, index).select(draw, place, hash_, F.explode(here).alias(here))  # the md5 before the groups
    target = F.coalesce(F.col(here)[first] + F.col(hash_) % F.col(here)[size], F.lit(-1).cast("long"))  # never null, so that no filter computes it once more
    asked = hashed.select(draw, place, target.alias(at)).repartition(tasks, at)
    found = asked.join(rows.repartition(tasks, number).hint(how), F.col(at) == F.col(number))
    return found.select(*keys, F.col(place).alias("place"), F.col(draw).alias("draw"), *(c for c in df.columns if c not in keys))


def md5_ratio_ci(sums: DataFrame, draws: int, seed: str, keys=("domain",), order=("item_id",), convention: str = "count") -> DataFrame:
    """n, units, mean, low, high, kept per group of rows (value, size): items with a size of 1, or ``cluster_sums``.  The
    rows drawn are counted by (value, size) and handed to the kernel of ``ratio_draws``."""
    value = F.round(F.col("value").cast("double"), 12).alias("value")
    rows = written(sums.select(*keys, *order, value, "size"), "drawn-rows")  # read by both
    histogram = rows.groupBy(*keys, "value", "size").agg(F.count(F.lit(1)).alias("items"))
    name = F.concat_ws("|", F.col("value").cast("string"), F.col("size").cast("string"))
    drawn = md5_draws(rows, draws, seed, keys, order, "shuffle_hash").groupBy(*keys, "draw", name.alias("pattern")).agg(F.count(F.lit(1)).alias("m"))
    return _ratio_ci(histogram, keys, draws, 0, convention, drawn)


def sized(df: DataFrame) -> DataFrame:
    """Rows that count as one each."""
    return df.withColumn("size", F.lit(1).cast("long"))


def md5_pattern_counts(folded: DataFrame, draws: int, seed: str, keys=("domain",), item=ITEM) -> DataFrame:
    """(keys, draw, pattern, m): how often an item of a pattern is drawn by md5, from ``item_patterns``."""
    own = [c for c in item if c not in keys]
    named = folded.select(*keys, *own, F.to_json(F.struct("pattern")).alias("pattern"))
    return md5_draws(named, draws, seed, keys, own, "shuffle_hash").groupBy(*keys, "draw", "pattern").agg(F.count(F.lit(1)).alias("m"))


def value_of(condition: Column) -> Column:
    """1.0 or 0.0, for rates."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
