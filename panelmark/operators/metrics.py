"""Agreement statistics from label counts.

All ratios are of doubles; undefined values (a chance agreement of 1, fewer than two categories) are null, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.operators.votes import ITEM

THIRDS = 2 / 3


def _d(x: Column) -> Column:
    return x.cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, _d(a) / _d(b))


def label_counts(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """(keys, item, label, c): one row per item and label.  Rows are dealt by item, which serves a fold of the items that
    follows as well: one shuffle for both."""
    names = list(dict.fromkeys([*keys, *item]))
    return ratings.where(F.col("label").isNotNull()).select(*names, "label").repartition(*names).groupBy(*names, "label").agg(F.count(F.lit(1)).alias("c"))


def item_shapes(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """Per item: n labels, distinct labels, the largest count, agreeing pairs.  One shuffle, on the item."""
    names = list(dict.fromkeys([*keys, *item]))
    counts = label_counts(ratings, keys, item)
    return counts.groupBy(*names).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.max("c").alias("most"), F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("agreeing"))


def item_patterns(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """(keys, item, pattern): each item's labels as a sorted array of (label, c)."""
    names = list(dict.fromkeys([*keys, *item]))
    return label_counts(ratings, keys, item).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("pattern"))


def label_patterns(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """(keys, pattern, items): how many items share a pattern, a sorted array of (label, c)."""
    return item_patterns(ratings, keys, item).groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("items"))


def binary_patterns(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """(keys, n, h, items): how many items have n valid labels, h of them HIGH."""
    names = list(dict.fromkeys([*keys, *item]))
    ok = F.col("label").isin("HIGH", "LOW")
    folded = ratings.where(ok).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") == "HIGH", 1).otherwise(0)).alias("h"))
    return folded.groupBy(*keys, "n", "h").agg(F.count(F.lit(1)).alias("items"))


def pattern_metrics(patterns: DataFrame, keys=("domain",), split_weight: float = 0.667, rounded: int | None = None) -> DataFrame:
    """n, weighted, all_agree, pairwise, fleiss_kappa, gwet_ac1 per group, from binary patterns."""
    h, n, m = F.col("h"), F.col("n"), F.col("items")
    l = n - h  # noqa: E741
    same = (h == 0) | (l == 0)
    sums = patterns.groupBy(*keys).agg(
        F.sum(m).alias("n_items"),
        F.sum(_d(m) * F.when(same, F.lit(1.0)).otherwise(F.lit(split_weight))).alias("w"),
        F.sum(m * F.when(same, 1).otherwise(0)).alias("u"),
        F.sum(m * (h * (h - 1) + l * (l - 1))).alias("agreeing"),
        F.sum(m * n * (n - 1)).alias("pairs"),
        F.sum(m * h).alias("highs"),
        F.sum(m * n).alias("labels"),
    )
    p = ratio(F.col("highs"), F.col("labels"))
    sums = sums.withColumns({"p": p, "pairwise": ratio(F.col("agreeing"), F.col("pairs"))})
    fleiss, gwet = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p")), 2 * F.col("p") * (1 - F.col("p"))
    values = {"weighted": ratio(F.col("w"), F.col("n_items")), "all_agree": ratio(F.col("u"), F.col("n_items")), "pairwise": F.col("pairwise"), "fleiss_kappa": ratio(F.col("pairwise") - fleiss, 1 - fleiss), "gwet_ac1": ratio(F.col("pairwise") - gwet, 1 - gwet)}
    if rounded is not None:
        values = {k: F.round(v, rounded) for k, v in values.items()}
    return sums.select(*keys, F.col("n_items").alias("n"), *(v.alias(k) for k, v in values.items()))


def panel_metrics(ratings: DataFrame, keys=("domain",), item=ITEM, split_weight: float = 0.667) -> DataFrame:
    return pattern_metrics(binary_patterns(ratings, keys, item), keys, split_weight)


def weighted_agreement(ratings: DataFrame, keys=("domain",), item=ITEM, split_weight: float = THIRDS) -> DataFrame:
    shapes = item_shapes(ratings, keys, item)
    return shapes.groupBy(*keys).agg(F.avg(F.when(F.col("kinds") == 1, F.lit(1.0)).otherwise(F.lit(split_weight))).alias("weighted"))


def majority_fraction_agreement(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """Mean share of the largest label, for any number of raters and labels."""
    return item_shapes(ratings, keys, item).groupBy(*keys).agg(F.avg(_d(F.col("most")) / _d(F.col("n"))).alias("agreement"))


def all_agree_rate(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    return item_shapes(ratings, keys, item).groupBy(*keys).agg(F.avg((F.col("kinds") == 1).cast("double")).alias("all_agree"))


def pairwise_agreement(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """Agreeing pairs of raters over all pairs, from counts: no pair is enumerated."""
    out = item_shapes(ratings, keys, item).groupBy(*keys).agg(F.sum("agreeing").alias("a"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("b"))
    return out.select(*keys, ratio(F.col("a"), F.col("b")).alias("pairwise"))


def fleiss_kappa(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    return panel_metrics(ratings, keys, item).select(*keys, "fleiss_kappa")


def gwet_ac1_panel(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """AC1 with pooled marginals; a single category has a chance agreement of 0 and an AC1 of 1."""
    return panel_metrics(ratings, keys, item).select(*keys, "gwet_ac1")


def gwet_ac1_nominal(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """n_items, categories, ac1 for any labels and items of any size from two ratings on.  Categories are those seen in
    these items; with fewer than two the value is null.  Marginals are means of the items' shares.

    One shuffle on the item; then patterns, then (label, share) rows beside one row of totals per pattern, so that
    nothing is computed twice or joined."""
    sized = label_patterns(ratings, keys, item).withColumn("n", F.aggregate("pattern", F.lit(0).cast("long"), lambda a, x: a + x.c)).where("n >= 2")
    agree = F.aggregate("pattern", F.lit(0).cast("long"), lambda a, x: a + x.c * (x.c - 1))
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    shares = F.transform("pattern", lambda x: F.struct(F.lit(False).alias("total"), x.label.alias("label"), (_d(F.col("items") * x.c) / _d(F.col("n"))).alias("share"), none.alias("items"), zero.alias("po")))
    total = F.struct(F.lit(True).alias("total"), F.lit(None).cast(dict(ratings.dtypes)["label"]).alias("label"), zero.alias("share"), F.col("items").alias("items"), (_d(F.col("items") * agree) / _d(F.col("n") * (F.col("n") - 1))).alias("po"))
    rows = sized.select(*keys, F.explode(F.concat(shares, F.array(total))).alias("x")).select(*keys, "x.*")
    labels = rows.groupBy(*keys, "total", "label").agg(F.sum("share").alias("share"), F.sum("items").alias("items"), F.sum("po").alias("po"))
    out = labels.groupBy(*keys).agg(F.sum("items").alias("n_items"), F.sum(F.when(~F.col("total"), 1).otherwise(0)).alias("q"), F.sum("po").alias("po"), F.sum("share").alias("s1"), F.sum(F.col("share") * F.col("share")).alias("s2"))
    n = _d(F.col("n_items"))
    chance = (F.col("s1") / n - F.col("s2") / (n * n)) / _d(F.col("q") - 1)
    return out.select(*keys, "n_items", F.col("q").alias("categories"), F.when(F.col("q") >= 2, ratio(F.col("po") / n - chance, 1 - chance)).alias("ac1"))


def two_rater_sums(pairs: DataFrame, a: str = "label_a", b: str = "label_b") -> list[Column]:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return [F.count(F.lit(1)).alias("n"), one(F.col(a) == F.col(b)).alias("same"), one(F.col(a) == "HIGH").alias("ha"), one(F.col(b) == "HIGH").alias("hb")]


def two_rater_values(sums: DataFrame, keys) -> DataFrame:
    po, pa, pb = (ratio(F.col(x), F.col("n")) for x in ("same", "ha", "hb"))
    cohen = pa * pb + (1 - pa) * (1 - pb)
    pi = (pa + pb) / 2
    gwet = 2 * pi * (1 - pi)
    return sums.select(*keys, "n", po.alias("agreement"), ratio(po - cohen, 1 - cohen).alias("cohen_kappa"), ratio(po - gwet, 1 - gwet).alias("gwet_ac1"))


def two_rater_metrics(pairs: DataFrame, keys=("domain",), rollup: bool = False) -> DataFrame:
    """n, agreement, cohen_kappa, gwet_ac1 of (label_a, label_b) per group; with ``rollup`` also over everything, in
    the same pass (its key is null and ``overall`` is true)."""
    if not rollup:
        return two_rater_values(pairs.groupBy(*keys).agg(*two_rater_sums(pairs)), keys)
    *outer, last = keys
    names = [*outer, last]
    sums = pairs.rollup(*names).agg(*two_rater_sums(pairs), F.grouping(last).alias("overall"))
    if outer:
        sums = sums.where(F.coalesce(*(F.col(c) for c in outer)).isNotNull())
    return two_rater_values(sums.withColumn("overall", F.col("overall") == 1), [*names, "overall"])


def metric_floor(k: int, labels: int, tau: float, n: int) -> tuple[float, int]:
    """(least possible weighted agreement, unanimous items of n that reach ``tau`` when all others are at the floor)."""
    floor = math.ceil(k / labels) / k
    need = n * (tau - floor) / (1 - floor) if floor < 1 else 0
    return floor, max(0, math.ceil(round(need, 9)))


def with_metric_floor(values: DataFrame, value: str, k: Column, labels: Column, tau: float, n: Column) -> DataFrame:
    """Add floor, required_unanimous and the floor-normalised value (0 and null where the floor is 1: one label an item)."""
    floor = F.ceil(_d(k) / _d(labels)) / _d(k)
    out = values.withColumn("floor", floor)
    open_ = F.when(F.col("floor") < 1, 1 - F.col("floor"))
    need = F.ceil(F.round(_d(n) * (F.lit(tau) - F.col("floor")) / open_, 9))
    return out.withColumns({"required_unanimous": F.coalesce(F.greatest(F.lit(0), need), F.lit(0)).cast("long"), "normalised": (F.col(value) - F.col("floor")) / open_})
