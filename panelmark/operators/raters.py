"""Raters: prevalence, pairs, subsets, replacements, missing labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.functions.text import QUOTE_CHARS, sanitize_quote
from panelmark.operators.keys import joined
from panelmark.operators.metrics import item_shapes, panel_metrics, ratio, two_rater_metrics, two_rater_values
from panelmark.operators.pairs import pair_labels, swap_rater
from panelmark.operators.votes import ITEM, majority
from panelmark.sources.shared import written


def rater_prevalence(ratings: DataFrame, keys=("domain", "rater_id")) -> DataFrame:
    """Labels and share of HIGH per rater and group."""
    out = ratings.where(F.col("label").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") == "HIGH", 1).otherwise(0)).alias("h"))
    return out.select(*keys, "n", ratio(F.col("h"), F.col("n")).alias("high_rate"))


def degenerate_raters(ratings: DataFrame, min_minor_share: float = 0.0, keys=("domain", "rater_id")) -> DataFrame:
    """Raters whose labels other than their commonest make up no more than the given share."""
    counts = ratings.where(F.col("label").isNotNull()).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("c").alias("most"))
    return out.select(*keys, "n", ratio(F.col("n") - F.col("most"), F.col("n")).alias("minor_share")).where(F.col("minor_share") <= min_minor_share)


#: Raters of an item whose labels meet in one row.
PAIR_BLOCK = 64


def rater_pair_matrix(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """Agreement, kappa and AC1 of each pair of raters: pairs come from one sorted array per item, not a self-join.

    Items with equal arrays are counted first.  An array is cut into blocks of ``PAIR_BLOCK``, and each two blocks are a
    row of their own, so no row holds more than the square of a block, however many raters an item has."""
    names = list(dict.fromkeys([*keys, *item]))
    arrays = ratings.where(F.col("label").isNotNull()).groupBy(*names).agg(F.array_sort(F.collect_set(F.struct("rater_id", "label"))).alias("r"))
    patterns = arrays.groupBy(*keys, "r").agg(F.count(F.lit(1)).alias("items"))
    last = F.floor((F.size("r") - 1) / PAIR_BLOCK).cast("int")
    first = patterns.select(*keys, "items", "r", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    both = first.select(*keys, "items", "r", "i", F.explode(F.sequence("i", "last")).alias("j"))
    block = lambda c: F.slice("r", F.col(c) * PAIR_BLOCK + 1, F.lit(PAIR_BLOCK))
    both = both.select(*keys, "items", block("i").alias("own"), block("j").alias("other"), (F.col("i") == F.col("j")).alias("same_block"))
    with_ = lambda x, k: F.transform(F.when(F.col("same_block"), F.slice("other", k + 2, F.lit(PAIR_BLOCK))).otherwise(F.col("other")), lambda y: F.struct(x.rater_id.alias("rater_a"), y.rater_id.alias("rater_b"), x.label.alias("a"), y.label.alias("b")))
    p = both.select(*keys, "items", F.explode(F.flatten(F.transform("own", with_))).alias("p")).select(*keys, "items", "p.*").where("rater_a <> rater_b")
    one = lambda c: F.sum(F.when(c, F.col("items")).otherwise(0))
    group = [*keys, "rater_a", "rater_b"]
    sums = p.groupBy(*group).agg(F.sum("items").alias("n"), one(F.col("a") == F.col("b")).alias("same"), one(F.col("a") == "HIGH").alias("ha"), one(F.col("b") == "HIGH").alias("hb"))
    return two_rater_values(sums, group)


#: Raters of a sweep at most (2 ** MOST_RATERS subsets), and label patterns that one task holds.
MOST_RATERS, PATTERN_BLOCK = 20, 4096


def superset_sums(present: np.ndarray, high: np.ndarray, items: np.ndarray, raters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(subset, HIGH votes in it, items): over all patterns of who rated (``present``) and who said HIGH, as bit masks, the
    items that all of a subset's raters have rated, by their HIGH votes within the subset.

    One rater after the other is summed out: outside the subset whatever it said, inside it only if it rated.  Rows with
    one mask of what is left are merged each time, so the work is raters x 2 ** raters at most, not patterns x subsets.
    A rater's bit in the first mask says "rated" before its turn and "in the subset" after it."""
    mask, own, votes, n = present.astype(np.int64), (high & present).astype(np.int64), np.zeros(len(items), np.int64), items.astype(np.int64)
    for r in range(raters):
        bit = 1 << r
        rated = (mask & bit) > 0
        key = np.concatenate([mask & ~bit, mask[rated]])
        left = np.concatenate([own & ~bit, own[rated] & ~bit])
        counted = np.concatenate([votes, votes[rated] + ((own[rated] & bit) > 0)])
        weight = np.concatenate([n, n[rated]])
        packed = ((key << raters | left) << 5) | counted
        packed, at = np.unique(packed, return_inverse=True)
        n = np.zeros(len(packed), np.int64)
        np.add.at(n, at, weight)
        votes, own, mask = packed & 31, (packed >> 5) & ((1 << raters) - 1), packed >> (5 + raters)
    return mask, votes, n


def panel_subset_sweep(ratings: DataFrame, raters: list[str], kmin: int = 2, keys=("domain",), item=ITEM) -> DataFrame:
    """For every subset of the named raters: n, A, floor, floor-normalised A*, and its rank by each in its group.

    An item's labels are two bit masks, of the raters that gave one and of those that said HIGH.  Items are counted by
    masks, masks are dealt to blocks of about ``PATTERN_BLOCK``, and each block is summed over all supersets at once.
    Items that lack a label of a subset's rater take no part in that subset; subsets without items have no row.  Of
    several ratings of one rater the greatest label counts.  Up to ``MOST_RATERS`` raters."""
    if len(raters) > MOST_RATERS:
        raise ValueError(f"{len(raters)} raters, {MOST_RATERS} at most")
    if not keys:
        raise ValueError("name at least one key")
    keys, names, size = list(keys), list(dict.fromkeys([*keys, *item])), len(raters)
    masks = F.create_map(*(F.lit(x) for i, r in enumerate(raters) for x in (r, 1 << i)))
    mask = F.try_element_at(masks, F.col("rater_id"))
    best = ratings.where(F.col("label").isNotNull() & mask.isNotNull()).groupBy(*names, mask.alias("mask")).agg(F.max("label").alias("label"))
    folded = best.groupBy(*names).agg(F.sum("mask").cast("long").alias("present"), F.sum(F.when(F.col("label") == "HIGH", F.col("mask")).otherwise(0)).cast("long").alias("high"))
    patterns = folded.groupBy(*keys, "present", "high").agg(F.count(F.lit(1)).alias("items"))
    patterns = written(patterns, "rater-masks")
    blocks = patterns.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PATTERN_BLOCK).cast("int").alias("blocks"))
    dealt = joined(patterns, blocks, keys).withColumn("block", F.pmod(F.xxhash64("present", "high"), F.col("blocks")).cast("int"))

    def swept(key, frame: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        subset, votes, n = superset_sums(*(frame[c].to_numpy() for c in ("present", "high", "items")), size)
        enough = np.bitwise_count(subset) >= kmin
        out = pd.DataFrame({"subset_mask": subset[enough], "h": votes[enough], "n": n[enough]})
        for k, value in zip(reversed(keys), reversed(key[:-1]), strict=True):
            out.insert(0, k, [value] * len(out))
        return out

    kinds = dict(patterns.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "subset_mask long, h long, n long"])
    k = F.bit_count("subset_mask")
    sums = dealt.groupBy(*keys, "block").applyInPandas(swept, schema).groupBy(*keys, "subset_mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.greatest(F.col("h"), k - F.col("h"))).alias("most"))
    named = F.array_join(F.array_compact(F.array(*(F.when(F.col("subset_mask").bitwiseAND(1 << i) > 0, F.lit(r)) for i, r in enumerate(raters)))), "+")
    sums = sums.select(*keys, named.alias("subset"), k.cast("int").alias("k"), "n", "most")
    floor = F.ceil(F.col("k").cast("double") / 2.0).cast("double") / F.col("k").cast("double")
    out = sums.select(*keys, "subset", "k", "n", ratio(F.col("most"), F.col("n") * F.col("k")).alias("a"), floor.alias("floor"))
    out = out.withColumn("a_star", (F.col("a") - F.col("floor")) / (1 - F.col("floor")))
    by = lambda c: F.rank().over(W.partitionBy(*keys).orderBy(F.desc(F.round(c, 9))))  # noqa: E731  one row per subset
    return out.withColumns({"rank_a": by("a"), "rank_a_star": by("a_star")})


def replaced_rater(ratings: DataFrame, out: str, new: DataFrame, keys=("domain",)) -> DataFrame:
    """Panel metrics before and after one rater's labels are swapped, in one table (``condition``)."""
    before = panel_metrics(ratings, keys).withColumn("condition", F.lit("original"))
    return before.unionByName(panel_metrics(swap_rater(ratings, out, new), keys).withColumn("condition", F.lit("replaced")))


def leave_one_out_fit(ratings: DataFrame, official: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """For each rater left out: items whose other labels, as a multiset, equal the recorded ones (``labels``, joined by
    bars in any order).  The best choice has rank 1; ties go to the smaller name."""
    names = list(dict.fromkeys([*keys, *item]))
    panel = ratings.where(F.col("label").isNotNull()).groupBy(*names).agg(F.collect_list(F.struct("rater_id", "label")).alias("r"))
    both = panel.join(official.select(*item, F.array_sort(F.split("labels", "[|]")).alias("recorded")), list(item))
    each = both.select(*keys, "r", "recorded", F.explode(F.array_distinct(F.transform("r", lambda x: x.rater_id))).alias("dropped"))
    rest = F.array_sort(F.transform(F.filter("r", lambda x: x.rater_id != F.col("dropped")), lambda x: x.label))
    fit = each.groupBy(*keys, "dropped").agg(F.count(F.lit(1)).alias("n"), F.sum((rest == F.col("recorded")).cast("long")).alias("fitting"))
    return fit.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("fitting"), "dropped")))


def best_subset(fits: DataFrame) -> DataFrame:
    return fits.where("rank = 1").drop("rank")


def reinstate_rater(ratings: DataFrame, drop: str, other: DataFrame, rule: str = "plurality_tie_low", item=ITEM) -> DataFrame:
    """Per item: consensus with all raters, without ``drop``, the label to compare with, and whether the consensus
    changes.  Two-rater metrics of either consensus against ``other`` follow from it."""
    all_ = majority(ratings, rule, item).withColumnRenamed("label", "with_all")
    less = majority(ratings.where(F.col("rater_id") != drop), rule, item).withColumnRenamed("label", "without")
    joined = all_.join(less, list(item)).join(other.select(*item, F.col("label").alias("other")), list(item))
    return joined.withColumn("changed", F.col("with_all") != F.col("without"))


def reinstatement_metrics(compared: DataFrame, keys=("domain",)) -> DataFrame:
    sides = []
    for side in ("with_all", "without"):
        pairs = compared.select(*keys, F.col(side).alias("label_a"), F.col("other").alias("label_b"))
        sides.append(two_rater_metrics(pairs, keys).withColumn("consensus", F.lit(side)))
    return sides[0].unionByName(sides[1])


def missing_label_report(ratings: DataFrame, keys=("domain",), item=ITEM, allowed=("HIGH", "LOW")) -> DataFrame:
    """Per group and rater: ratings, valid ones, missing ones; and the group's items that lack a label, with how many of
    them the other labels agree on."""
    ok = F.coalesce(F.col("label").isin(*allowed), F.lit(False))
    per_rater = ratings.groupBy(*keys, "rater_id").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("valid"))
    names = list(dict.fromkeys([*keys, *item]))
    items = ratings.groupBy(*names).agg(F.sum((~ok).cast("long")).alias("lacking"), F.count_distinct(F.when(ok, F.col("label"))).alias("kinds"))
    group = items.groupBy(*keys).agg(F.sum((F.col("lacking") > 0).cast("long")).alias("items_lacking"), F.sum(((F.col("lacking") > 0) & (F.col("kinds") == 1)).cast("long")).alias("rest_agrees"))
    return per_rater.withColumn("missing", F.col("n") - F.col("valid")).join(group, list(keys))


def complete_cases(ratings: DataFrame, item=ITEM, allowed=("HIGH", "LOW")) -> DataFrame:
    """Ratings of the items that have only valid labels."""
    bad = ratings.where(~F.coalesce(F.col("label").isin(*allowed), F.lit(False))).select(*item).distinct()
    return ratings.join(bad, list(item), "left_anti")


def split_profile(ratings: DataFrame, keys=("domain",), item=ITEM) -> DataFrame:
    """Items whose labels are all equal, partly equal, all different (items of two labels or more)."""
    shapes = item_shapes(ratings, keys, item).where("n >= 2")
    count = lambda c: F.sum(c.cast("long"))
    k, n = F.col("kinds"), F.col("n")
    return shapes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), count(k == 1).alias("unanimous"), count((k > 1) & (k < n)).alias("partly"), count(k == n).alias("all_different"), F.avg(F.col("agreeing").cast("double") / (n * (n - 1) / 2)).alias("mean_pair_agreement"))


def criterion_counts(ratings: DataFrame, panel: DataFrame, item=ITEM) -> DataFrame:
    """How often each rater matched each criterion number on items where the panel disagreed, by side."""
    split = panel.where(~F.col("all_agree")).select(*item)
    on = joined(ratings, split, item, "left_semi")
    sides = [on.select("domain", "rater_id", F.lit(side).alias("side"), F.explode(f"matched_{side.lower()}").alias("criterion")) for side in ("HIGH", "LOW")]
    return sides[0].unionByName(sides[1]).groupBy("domain", "rater_id", "side", "criterion").agg(F.count(F.lit(1)).alias("n"))


def quote_counts(ratings: DataFrame, panel: DataFrame, n_quote: int = QUOTE_CHARS, item=ITEM) -> DataFrame:
    """How often each rater named each quote as the criterion that decided, on items where the panel disagreed.  Quotes
    are sanitized; null and empty ones are none."""
    split = panel.where(~F.col("all_agree")).select(*item)
    quoted = joined(ratings, split, item, "left_semi").select("domain", "rater_id", sanitize_quote(F.col("criterion_quote"), n_quote).alias("quote"))
    return quoted.where(F.trim("quote") != "").groupBy("domain", "rater_id", "quote").agg(F.count(F.lit(1)).alias("n"))


def cluster_coverage(clusters: DataFrame, keys=("corpus",)) -> DataFrame:
    """Clusters of a corpus and the most items that one of them has."""
    sizes = clusters.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("most_items"), F.sum("n").alias("items"))


def cluster_sketches(clusters: DataFrame, keys=("corpus",), precision: int = 14) -> DataFrame:
    """(keys, items, sketch): a HyperLogLog sketch of each group's clusters, to be kept per file or batch.  Sketches of
    one precision merge without the rows; a null cluster is none."""
    return clusters.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.hll_sketch_agg("cluster_id", F.lit(precision)).alias("sketch"))


def merged_coverage(sketches: DataFrame, keys=("corpus",)) -> DataFrame:
    """(keys, items, clusters) of sketches from any number of batches.  ``clusters`` is an estimate: its relative standard
    error is about 0.8 / 2 ** (precision / 2), 0.65 % at 14; ``cluster_coverage`` has the exact number."""
    return sketches.groupBy(*keys).agg(F.sum("items").alias("items"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("clusters"))


def label_distribution(ratings: DataFrame, rule: str = "abs2") -> DataFrame:
    """Share of HIGH of each rater and of the majority, per domain and over all (domain null)."""
    major = majority(ratings, rule).select("domain", F.lit("majority").alias("rater_id"), "label")
    both = ratings.where(F.col("label").isNotNull()).select("domain", "rater_id", "label").unionByName(major)
    counts = both.groupBy("domain", "rater_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == "HIGH").cast("long")).alias("h"))
    out = counts.groupingSets([("domain", "rater_id"), ("rater_id",)], "domain", "rater_id").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    return out.select("domain", "rater_id", "n", ratio(F.col("h"), F.col("n")).alias("high_rate"))


def label_changes(a: DataFrame, b: DataFrame, item=ITEM) -> DataFrame:
    """Items whose label differs between two panels."""
    return pair_labels(a, b, item).where("label_a <> label_b")
