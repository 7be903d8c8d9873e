"""Iteration history of a calibration: domains x iterations, a small table after aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.operators.keys import unused


def by():  # noqa: ANN201
    return W.partitionBy("domain").orderBy("iteration")


def iteration_delta(history: DataFrame) -> DataFrame:
    """Change to the iteration before; the first changes from 0."""
    return history.withColumn("delta", F.col("weighted") - F.coalesce(F.lag("weighted").over(by()), F.lit(0.0)))


def stagnation_flag(history: DataFrame, rule: str = "code", small: float = 0.02) -> DataFrame:
    """``code``: the last two changes are both smaller than ``small``, from the third point on.  ``paper``: no gain in
    three changes running."""
    now, one, two = F.col("weighted"), F.lag("weighted").over(by()), F.lag("weighted", 2).over(by())
    if rule == "code":
        flag = (F.abs(now - one) < small) & (F.abs(one - two) < small)
    elif rule == "paper":
        three = F.lag("weighted", 3).over(by())
        flag = (F.round(now - one, 12) <= 0) & (F.round(one - two, 12) <= 0) & (F.round(two - three, 12) <= 0)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return history.withColumn("stagnated", F.coalesce(flag, F.lit(False)))


def best_so_far(history: DataFrame) -> DataFrame:
    return history.withColumn("best", F.max("weighted").over(by().rowsBetween(W.unboundedPreceding, 0)))


def best_iteration(history: DataFrame) -> DataFrame:
    """The earliest iteration with the highest value, per domain."""
    first = W.partitionBy("domain").orderBy(F.desc("weighted"), "iteration")
    rank = unused(history, "rank")
    return history.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)


def best_labels(ratings: DataFrame, history: DataFrame) -> DataFrame:
    """Ratings of each domain's best iteration."""
    return ratings.join(best_iteration(history).select("domain", "iteration"), ["domain", "iteration"], "left_semi")


def converged_at(history: DataFrame, tau: float = 0.8) -> DataFrame:
    """First iteration at or over ``tau``; null if there is none."""
    return history.groupBy("domain").agg(F.min(F.when(F.col("weighted") >= tau, F.col("iteration"))).alias("converged_at"))


def regression_flag(history: DataFrame, tau: float = 0.8, drop: float = 0.10) -> DataFrame:
    """After convergence, a fall of more than ``drop`` from the iteration before."""
    before = F.lag("weighted").over(by())
    reached = F.max(F.when(F.col("weighted") >= tau, 1).otherwise(0)).over(by().rowsBetween(W.unboundedPreceding, -1))
    flag = (F.coalesce(reached, F.lit(0)) == 1) & (F.round(before - F.col("weighted"), 12) > drop)
    return history.withColumn("regressed", F.coalesce(flag, F.lit(False)))


def loop_action(history: DataFrame, tau: float = 0.8, max_iterations: int = 10, small: float = 0.02) -> DataFrame:
    """What the loop does after an iteration, in the order of its tests: converged, stagnated, done, revise."""
    marked = stagnation_flag(history, "code", small)
    action = F.when(F.col("weighted") >= tau, "converged").when(F.col("stagnated"), "stagnated").when(F.col("iteration") >= max_iterations, "done").otherwise("revise")
    return marked.withColumn("action", action).drop("stagnated")


def calibration_summary(history: DataFrame, tau: float = 0.8, drop: float = 0.10, changes: DataFrame | None = None, irreducible: DataFrame | None = None) -> DataFrame:
    """One row per domain: last and best values, histories rounded to 3 places, flags, latest and best version, rubric
    changes and items given up.

    Both versions are reported: the latest rubric need not be the best one.  ``converged`` is the state at the end: the
    domain reached ``tau`` and has not fallen by more than ``drop`` after.  Without ``changes`` (domain, iteration) the
    changes of version in the history count; without ``irreducible`` (domain, item_id) no item is given up."""
    rows = history if "rubric_version" in history.columns else history.withColumn("rubric_version", (F.col("iteration") - 1).cast("string"))
    rows = regression_flag(rows, tau, drop).withColumn("moved", F.coalesce(F.col("rubric_version") != F.lag("rubric_version").over(by()), F.lit(False)))
    points = F.array_sort(F.collect_list(F.struct("iteration", "weighted", "all_agree", "rubric_version", "regressed", "moved")))
    out = rows.groupBy("domain").agg(points.alias("p"))
    take = lambda f: F.transform("p", lambda x: F.round(x[f], 3))
    last = F.element_at("p", -1)
    best = F.aggregate("p", F.element_at("p", 1), lambda a, x: F.when(x.weighted > a.weighted, x).otherwise(a))
    state = F.aggregate("p", F.lit(False), lambda a, x: (a & ~x.regressed) | (x.weighted >= tau))
    counted = lambda df, name: df.groupBy("domain").agg(F.count(F.lit(1)).alias(name))
    for table, name in ((changes, "rubric_changes"), (irreducible.distinct() if irreducible is not None else None, "irreducible_count")):
        out = out.join(counted(table, name), "domain", "left") if table is not None else out.withColumn(name, F.lit(None).cast("long"))
    moved = F.size(F.filter("p", lambda x: x.moved)).cast("long") if changes is None else F.lit(0).cast("long")
    return out.select(
        "domain",
        last.weighted.alias("final_weighted"),
        last.all_agree.alias("final_all_agree"),
        best.weighted.alias("best_weighted"),
        best.iteration.alias("best_iteration"),
        take("weighted").alias("weighted_history"),
        take("all_agree").alias("all_agree_history"),
        state.alias("converged"),
        F.exists("p", lambda x: x.regressed).alias("regression_detected"),
        F.size("p").alias("iterations"),
        last.rubric_version.alias("final_version"),
        best.rubric_version.alias("best_version"),
        F.coalesce("irreducible_count", F.lit(0).cast("long")).alias("irreducible_count"),
        F.coalesce("rubric_changes", moved).alias("rubric_changes"),
    )
