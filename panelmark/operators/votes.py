"""Ratings to votes: one row per item from one row per (item, rater).

Every fold groups by the whole item key, never by domain alone, so that few large domains make no large groups.
Statistics are then taken from *patterns*: how many items share the same label counts.  That table is small however many
items there are, and every panel statistic and every item bootstrap is a function of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmark.functions import text as tx
from panelmark.operators.keys import joined, unused
from panelmark.sources.shared import tasks_for, written

LABELS = ("HIGH", "LOW")
ITEM = ("domain", "item_id")


def valid_labels(ratings: DataFrame, allowed=LABELS, missing: str = "drop_rating", item=ITEM) -> DataFrame:
    """Deal with labels outside ``allowed``: ``LOW`` takes them as LOW, ``drop_rating`` leaves the rating out,
    ``drop_item`` leaves out every item that has one."""
    ok = F.coalesce(F.col("label").isin(*allowed), F.lit(False))
    if missing == "LOW":
        return ratings.withColumn("label", F.when(ok, F.col("label")).otherwise("LOW"))
    if missing == "drop_rating":
        return ratings.where(ok)
    if missing == "drop_item":
        bad = ratings.where(~ok).select(*item).distinct()
        return ratings.join(bad, list(item), "left_anti")
    raise ValueError(f"unknown rule {missing!r}")


def consensus_ratings(human: DataFrame) -> DataFrame:
    """Ratings that count: no attention checks, no excluded annotators."""
    return human.where(~F.coalesce("is_attention_check", F.lit(False)) & F.coalesce("included_in_consensus", F.lit(True)))


def high(label: str = "label") -> Column:
    return F.sum(F.when(F.col(label) == "HIGH", 1).otherwise(0))


def low(label: str = "label") -> Column:
    return F.sum(F.when(F.col(label) == "LOW", 1).otherwise(0))


def _level(votes_high: Column, votes_low: Column, rule: str) -> Column:
    if rule == "abs2":  # two votes for HIGH, whatever is missing
        return F.when(votes_high >= 2, "HIGH").otherwise("LOW")
    if rule == "plurality_tie_low":
        return F.when(votes_high > votes_low, "HIGH").otherwise("LOW")
    raise ValueError(f"unknown rule {rule!r}")


def panel_vote(ratings: DataFrame, rule: str = "abs2", item=ITEM, fixed_raters: int | None = None, details: bool = False) -> DataFrame:
    """votes_high, votes_low, signal_level, agreement, all_agree per item; with ``details`` also the single ratings.

    Agreement is the larger vote over the valid labels, or over ``fixed_raters``; without valid labels it is 0 and
    all_agree is false."""
    aggregates = [high().alias("votes_high"), low().alias("votes_low")]
    if details:
        fields = [c for c in ("rater_id", "label", "reason", "criterion_quote", "matched_high", "matched_low") if c in ratings.columns]
        aggregates.append(F.array_sort(F.collect_list(F.struct(*fields))).alias("individual_results"))
    votes = ratings.groupBy(*item).agg(*aggregates)
    h, l = F.col("votes_high"), F.col("votes_low")  # noqa: E741
    valid = h + l
    over = F.lit(fixed_raters) if fixed_raters else valid
    out = votes.withColumns(
        {
            "signal_level": _level(h, l, rule),
            "agreement": F.when(valid > 0, F.greatest(h, l).cast("double") / over.cast("double")).otherwise(F.lit(0.0)),
            "all_agree": (valid > 0) & ((h == 0) | (l == 0)) & ((valid == fixed_raters) if fixed_raters else F.lit(True)),
        }
    )
    names = [*item, "signal_level", "agreement", "votes_high", "votes_low", "all_agree"]
    return out.select(*names, *(["individual_results"] if details else []))


def disagreement_cases(panel: DataFrame, items: DataFrame, n_text: int = tx.CASE_CHARS, n_quote: int = tx.QUOTE_CHARS, item=ITEM) -> DataFrame:
    """Split items of a panel with details: excerpt, and by rater votes, sanitized quotes, reasons, and the numbers of the
    criteria matched on each side (the latter three where the ratings have them).  Several ratings of one rater are
    joined by commas; a null rater has the key of an empty string."""
    single = F.col("individual_results")
    known = panel.schema["individual_results"].dataType.elementType.names
    ids = F.array_distinct(F.transform(single, lambda r: F.coalesce(r.rater_id.cast("string"), F.lit(""))))
    own = lambda i: F.filter(single, lambda r: F.coalesce(r.rater_id.cast("string"), F.lit("")) == i)
    by_rater = lambda f: F.map_from_arrays(ids, F.transform(ids, lambda i: F.array_join(F.transform(own(i), f), ", ")))
    quote = lambda r: tx.sanitize_quote(r.criterion_quote, n_quote) if "criterion_quote" in known else F.lit("")
    numbers = lambda side: lambda i: F.flatten(F.transform(own(i), lambda r: F.coalesce(r[side], F.array().cast("array<int>"))))
    found = {"votes": by_rater(lambda r: r.label), "quotes": by_rater(quote)}
    if "reason" in known:
        found["reasons"] = by_rater(lambda r: r.reason)
    for side in ("matched_high", "matched_low"):
        if side in known:
            found[side] = F.map_from_arrays(ids, F.transform(ids, numbers(side)))
    split = panel.where(~F.col("all_agree")).withColumns(found).drop("individual_results")
    return joined(split, items.select(*item, tx.truncate(F.col("text"), n_text).alias("excerpt")), item)


def majority(ratings: DataFrame, rule: str = "abs2", item=ITEM, order: str = "rater_id") -> DataFrame:
    """The panel's label per item.  ``plurality_first``: any labels, ties to the one seen first in ``order``.  Its ratings
    are dealt by item to as many tasks as their files need, apart from what comes before: no task holds the sorted rows of
    a join, the counts and the items at once."""
    if rule != "plurality_first":
        votes = ratings.groupBy(*item).agg(high().alias("h"), low().alias("l"))
        return votes.select(*item, _level(F.col("h"), F.col("l"), rule).alias("label"))
    dealt = ratings.where(F.col("label").isNotNull()).select(*item, "label", order).repartition(tasks_for(ratings), *item)
    counts = dealt.groupBy(*item, "label").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = W.partitionBy(*item).orderBy(F.desc("n"), "first", "label")
    return counts.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(*item, "label")


def agreement_breakdown(panel: DataFrame, keys=("domain",)) -> DataFrame:
    """Items evaluated, unanimous, split two to one or more, with fewer than two votes on a side, and their rates."""
    most = F.greatest("votes_high", "votes_low")
    unanimous = F.col("all_agree")
    partial = ~unanimous & (most >= 2)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("evaluated"), count(unanimous).alias("unanimous"), count(partial).alias("partial"), count(~unanimous).alias("disagreeing"))
    return out.withColumns({f"{c}_rate": F.col(c).cast("double") / F.col("evaluated").cast("double") for c in ("unanimous", "partial", "disagreeing")})


def loop_weight(split_weight: float = 0.667) -> Column:
    """Weight of an item inside the calibration loop: 1 for three equal votes, ``split_weight`` for two of a kind (also
    2-0 with a label missing), else 0."""
    most = F.greatest("votes_high", "votes_low")
    return F.when(most >= 3, F.lit(1.0)).when(most == 2, F.lit(split_weight)).otherwise(F.lit(0.0))


def latest_call(calls: DataFrame, key, sequence: str = "ingest_seq") -> DataFrame:
    """The last row of each key; of rows with one sequence number the one with the largest hash of all its columns."""
    last = W.partitionBy(*key).orderBy(F.desc(sequence), F.desc(row_hash(calls)))
    rank = unused(calls, "rank")
    return calls.withColumn(rank, F.row_number().over(last)).where(F.col(rank) == 1).drop(rank)


def round_of(items: DataFrame) -> DataFrame:
    """Round 1 has the even positions, round 2 the odd ones."""
    return items.withColumn("round", (F.col("item_id") % 2 + 1).cast("int"))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be compared, for an order of ties that does not depend on the run."""
    return F.xxhash64(F.lit(0), *(df[f.name] for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))


def with_row_index(df: DataFrame, order=None, by=None, name: str = "item_id") -> DataFrame:
    """Position in reading order (``order`` None), or within ``by`` groups in the given order, from 0, as column
    ``name`` (which replaces one of that name).

    The two are different keys: a position within a domain must not be joined to a global one.  Every row is written once
    to the shared folder with its task's number and its place in the task; counts per task and the rows themselves are
    then read from that one table, so both agree whatever partitions the plan would choose on another run.  A row's
    position is the number of rows in earlier tasks (of its group) plus its own place: no group and no table has to fit
    one task.  Rows with equal ``order`` come by a hash of the whole row, which also spreads them over tasks."""
    keys = list(by or [])
    kept = [c for c in df.columns if c.lower() != name.lower() or c in keys]
    part, at, first, n = (unused(df, c) for c in ("part", "place", "first", "rows"))
    if order is not None or keys:
        sort = [*(F.col(k) for k in keys), *(F.col(c) if isinstance(c, str) else c for c in order or [])]
        tie = unused(df, "tie")
        df = df.withColumn(tie, row_hash(df)).repartitionByRange(*sort, tie).sortWithinPartitions(*sort, tie).drop(tie)
    placed = written(df.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "row-index")
    counts = placed.groupBy(part, *keys).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(first))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row per task (and group in it)
    offsets = counts.select(part, *keys, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(first))
    out = joined(placed, offsets, [part, *keys])
    return out.select(*(out[c] for c in kept), (F.col(at) + F.col(first)).cast("long").alias(name))
