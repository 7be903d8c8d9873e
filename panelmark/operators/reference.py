"""Label sets against a reference, conditions against a base, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.operators.metrics import binary_patterns, gwet_ac1_nominal, item_shapes, panel_metrics, pattern_metrics, ratio, two_rater_metrics
from panelmark.operators.pairs import pair_labels
from panelmark.operators.votes import ITEM, high, low, majority


def match_vs_baseline(pairs: DataFrame, keys=("domain",), reference: str = "label_a", system: str = "label_b") -> DataFrame:
    """n, match, match_rate, majority-class baseline of the system's labels, and whether the rate is strictly above it."""
    same, h = F.sum((F.col(reference) == F.col(system)).cast("long")), F.sum((F.col(system) == "HIGH").cast("long"))
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), same.alias("match"), h.alias("system_high"), F.sum((F.col(reference) == "HIGH").cast("long")).alias("reference_high"))
    most = F.greatest(F.col("system_high"), F.col("n") - F.col("system_high"))
    return out.withColumns({"match_rate": ratio(F.col("match"), F.col("n")), "baseline": ratio(most, F.col("n")), "beats_baseline": F.col("match") > most})


def pooled_baseline(cells: DataFrame) -> DataFrame:
    """One row over all cells: matches, rate, baseline weighted by n, cells above their own baseline."""
    n = F.sum("n")
    return cells.agg(n.alias("n"), F.sum("match").alias("match"), ratio(F.sum("match"), n).alias("match_rate"), (F.sum(F.round(F.col("baseline") * F.col("n"))) / n.cast("double")).alias("baseline"), F.sum(F.col("beats_baseline").cast("long")).alias("cells_above"))


def build_gold(human: DataFrame, system: DataFrame, rule: str = "plurality_tie_low", item=ITEM) -> DataFrame:
    """Consensus per item with the labels in order of the annotators, votes, the system's label and the match."""
    names = list(dict.fromkeys([*item, *(["round"] if "round" in human.columns else [])]))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("annotator_id", "label"))), lambda x: x.label)
    folded = human.groupBy(*names).agg(labels.alias("labels"), high().alias("n_high"), low().alias("n_low"))
    votes = F.when(F.col("n_high") > F.col("n_low"), "HIGH").otherwise("LOW") if rule == "plurality_tie_low" else F.when(F.col("n_high") >= 2, "HIGH").otherwise("LOW")
    joined = folded.withColumn("human_consensus_label", votes).join(system.select(*item, F.col("label").alias("system_label")), list(item))
    out = joined.withColumns({"annotator_labels": F.array_join("labels", "|"), "match": (F.col("human_consensus_label") == F.col("system_label")).cast("int")})
    return out.select(*names, "human_consensus_label", "annotator_labels", "n_high", "n_low", "system_label", "match")


def majority_flips(before: DataFrame, after: DataFrame, item=ITEM) -> DataFrame:
    """Per domain: items compared, changed labels, and each direction."""
    pairs = pair_labels(before, after, item)
    a, b = F.col("label_a"), F.col("label_b")
    count = lambda c: F.sum(c.cast("long"))
    return pairs.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), count(a != b).alias("flips"), count((a == "HIGH") & (b == "LOW")).alias("to_low"), count((a == "LOW") & (b == "HIGH")).alias("to_high"))


def inclusion_sensitivity(ratings: DataFrame, flagged: DataFrame, tau: float = 0.8, item=ITEM, split_weight: float = 0.667) -> DataFrame:
    """Weighted agreement with and without flagged items per domain, the difference, and whether the verdict (at least
    ``tau``) changes.  One fold of the ratings serves both."""
    mark = flagged.select(*item).distinct().withColumn("flag", F.lit(1))
    shapes = item_shapes(ratings, ("domain",), item).join(mark, list(item), "left")
    w = F.when(F.col("kinds") == 1, F.lit(1.0)).otherwise(F.lit(split_weight))
    out = shapes.groupBy("domain").agg(F.count(F.lit(1)).alias("n_all"), F.sum(F.coalesce("flag", F.lit(0)).cast("long")).alias("n_flagged"), F.avg(w).alias("with_flagged"), F.avg(F.when(F.col("flag").isNull(), w)).alias("without_flagged"))
    return out.withColumns({"difference": F.col("without_flagged") - F.col("with_flagged"), "verdict_changes": (F.round("with_flagged", 9) >= tau) != (F.round("without_flagged", 9) >= tau)})


def compare_conditions(ratings: DataFrame, condition: str, base: str, keys=("domain",), item=ITEM) -> DataFrame:
    """Panel metrics per condition and their differences to the base condition."""
    names = (*keys, condition)
    values = pattern_metrics(binary_patterns(ratings, names, (*item, condition)), names)
    ground = W.partitionBy(*keys)
    diff = lambda c: F.col(c) - F.max(F.when(F.col(condition) == base, F.col(c))).over(ground)
    return values.withColumns({"weighted_delta": diff("weighted"), "ac1_delta": diff("gwet_ac1")})


def cost_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Per role: calls, mean and total tokens, cost, cost per 1000 calls, and its ratio to the cheapest role.

    calls: role, input_tokens, output_tokens; prices: role, input_price, output_price (per million tokens)."""
    sums = calls.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    priced = sums.join(prices, "role")
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / F.lit(1e6)
    out = priced.withColumn("cost", cost).withColumns({"mean_input": ratio(F.col("input_tokens"), F.col("calls")), "mean_output": ratio(F.col("output_tokens"), F.col("calls")), "cost_per_1k": F.col("cost") * 1000 / F.col("calls")})
    out = out.withColumn("ratio", F.col("cost_per_1k") / F.min("cost_per_1k").over(W.partitionBy()))  # one row per role
    return out.drop("input_price", "output_price")


def reliability_table(human: DataFrame, system: DataFrame, draws: int = 10_000, seed: int = 0, md5_seed: str | None = None) -> DataFrame:
    """Per domain: AC1 of people and of raters with intervals, A, unanimous items, and both ranks.  With ``md5_seed`` the
    draws are those that SQL can repeat."""
    from panelmark.operators.resample import bootstrap_ac1_ci

    def side(ratings, name):
        ci = bootstrap_ac1_ci(ratings, ("domain",), draws=draws, seed=seed, md5_seed=md5_seed)
        ci = ci.select("domain", F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"), F.col("kept").alias(f"{name}_kept"))
        return gwet_ac1_nominal(ratings).select("domain", F.col("n_items").alias(f"{name}_items"), F.col("ac1").alias(f"{name}_ac1")).join(ci, "domain", "left")

    panel = panel_metrics(system, split_weight=2 / 3).select("domain", F.col("weighted").alias("system_a"), F.col("all_agree").alias("system_unanimous"))
    out = side(human, "human").join(side(system, "system"), "domain").join(panel, "domain")
    rank = lambda c: F.rank().over(W.partitionBy().orderBy(F.desc(c)))  # noqa: E731  one row per domain
    return out.withColumns({"human_rank": rank("human_ac1"), "system_rank": rank("system_ac1")})


def repeat_stability(draws: DataFrame, n_repeats: int | None = None, item=ITEM) -> DataFrame:
    """Per variant and item: labels in order of the repeats, majority (ties to the first seen), its share, stability."""
    names = ["variant", *item]
    folded = draws.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("repeat", "label"))), lambda x: x.label).alias("labels"))
    counted = F.transform(F.array_distinct("labels"), lambda x: F.struct((-F.size(F.filter("labels", lambda y: y == x))).alias("minus"), F.array_position("labels", x).alias("first"), x.alias("label")))
    best = folded.withColumn("best", F.array_min(counted))
    out = best.select(*names, "labels", F.col("best.label").alias("label"), (-F.col("best.minus")).alias("votes"), F.size("labels").alias("draws"))
    out = out.withColumns({"ratio": ratio(F.col("votes"), F.col("draws")), "stable": F.col("votes") == F.col("draws")})
    return out.withColumn("complete", F.col("draws") == n_repeats) if n_repeats else out


def stability_summary(items: DataFrame) -> DataFrame:
    """Per variant, and per variant and domain (one pass): items, stable ones, their share, mean share of the majority."""
    out = items.groupingSets([("variant", "domain"), ("variant",)], "variant", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stable").cast("long")).alias("stable"), F.avg("ratio").alias("mean_ratio"))
    return out.withColumn("stable_share", ratio(F.col("stable"), F.col("n")))


def repeat_majority_vs_reference(draws: DataFrame, reference: DataFrame, item=ITEM) -> DataFrame:
    """Majority of the repeats, and the first draw alone, against a reference: two-rater metrics per variant."""
    names = ["variant", *item]
    most = repeat_stability(draws, item=item).select(*names, "label").withColumn("labels", F.lit("majority"))
    single = draws.where(F.col("repeat") == 0).select(*names, "label").withColumn("labels", F.lit("single"))
    ref = reference.select(*item, F.col("label").alias("label_b"))
    pairs = most.unionByName(single).withColumnRenamed("label", "label_a").join(ref, list(item))
    return two_rater_metrics(pairs, ("variant", "labels"))


def majority_pairs(ratings: DataFrame, reference: DataFrame, rule: str = "abs2", item=ITEM) -> DataFrame:
    return pair_labels(reference, majority(ratings, rule, item), item)
