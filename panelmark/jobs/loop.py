"""The calibration loop: label, fold, measure, decide, revise.  Raters and revisers are functions of the caller.

One Spark job per iteration; its ratings are appended to the call log and read back, so plans do not grow and a stopped
run goes on where it was: calls that the log has are not made again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.functions.text import validate_revision
from panelmark.operators import history as h
from panelmark.operators.keys import joined, unused
from panelmark.operators.metrics import panel_metrics
from panelmark.operators.pairs import attach_rubric, exclude_items, pending_calls, plan_calls, top_cases
from panelmark.operators.votes import disagreement_cases, panel_vote
from panelmark.sources.shared import written
from panelmark.sources.tables import append_calls

#: A rater takes (rater_id, frame of items with rubric columns) and gives a frame with the label fields, row by row.
Rater = Callable[[str, pd.DataFrame], pd.DataFrame]
FIELDS = ("label", "confidence", "reason", "criterion_quote")
#: Tasks of the raters for each core, at most, unless a task would have more calls than the second.
TASKS_PER_CORE, TASK_CALLS = 8, 65_536
CALLS = "run_tag string, domain string, rubric_version string, item_id long, rater_id string, repeat int, label string, confidence string, reason string, criterion_quote string"


def label_items(pending: DataFrame, rater: Rater, calls_per_task: int = 256, calls: int | None = None) -> DataFrame:
    """Run the rater over pending calls (with text and rubric).  Rows are dealt by rater and a salt and sorted by rater,
    so a worker loads a model once, and few raters still fill many tasks; the number of tasks follows that of the
    ``calls`` (counted if not given), up to ``TASKS_PER_CORE`` for each core: more would not be done sooner, and the pieces
    of a shuffle would grow with the square of the calls.  Beyond that a task has up to ``TASK_CALLS``.  A rater that raises gives LOW labels with the error as the reason."""
    calls = pending.count() if calls is None else calls
    most = max(TASKS_PER_CORE * pending.sparkSession.sparkContext.defaultParallelism, -(-calls // TASK_CALLS))
    tasks = max(1, min(most, -(-calls // calls_per_task)))

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            for name, part in frame.groupby("rater_id", sort=False):
                try:
                    got = rater(name, part)[list(FIELDS)].reset_index(drop=True)
                except Exception as e:  # noqa: BLE001  a failed call is a result of its own
                    got = pd.DataFrame({"label": "LOW", "confidence": "LOW", "reason": f"Error: {e}", "criterion_quote": ""}, index=range(len(part)))
                keys = part[["run_tag", "domain", "rubric_version", "item_id", "rater_id", "repeat"]].reset_index(drop=True)
                yield pd.concat([keys, got], axis=1)

    salt = unused(pending, "salt")
    salted = pending.withColumn(salt, F.pmod(F.xxhash64("domain", "item_id"), F.lit(tasks)))
    dealt = salted.repartition(tasks, "rater_id", salt).sortWithinPartitions("rater_id", "domain", "item_id").drop(salt)
    return dealt.mapInPandas(run, CALLS)


def rule_rater(rater_id: str, frame: pd.DataFrame) -> pd.DataFrame:
    """A test double: HIGH if the text is long for this rater's taste."""
    limit = 200 + 400 * (sum(map(ord, rater_id)) % 5)
    label = (frame["text"].fillna("").str.len() >= limit).map({True: "HIGH", False: "LOW"})
    return pd.DataFrame({"label": label, "confidence": "HIGH", "reason": f"length against {limit}", "criterion_quote": ""})


def read_log(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CALLS)
    names = [x.split()[0] for x in CALLS.split(", ")]
    return spark.read.schema(CALLS).parquet(path).select(*names)


class Calibration(NamedTuple):
    """history: domain, iteration, weighted, all_agree, rubric_version; rubrics: those of each domain's best iteration;
    changes: domain, iteration, agreement_before, reasoning, diagnosis; irreducible: domain, item_id; summary: one row per domain."""

    history: DataFrame
    rubrics: DataFrame
    changes: DataFrame
    irreducible: DataFrame
    summary: DataFrame


HISTORY = "domain string, iteration int, weighted double, all_agree double, rubric_version string"


def revise(current: DataFrame, asked: dict[str, tuple[dict, list[dict], list[dict]]], reviser, retries: int) -> dict:  # noqa: ANN001
    """Rows of ``validate_revision`` by domain.  A domain whose answer is not valid, or whose reviser raises, is asked
    again, ``retries`` times in all; ``attempts`` says how often it was."""
    spark, done = current.sparkSession, {}
    for attempt in range(1, retries + 1):
        answers = []
        for domain, args in asked.items():
            if domain in done and done[domain]["success"]:
                continue
            try:
                answers.append((domain, reviser(domain, *args)))
            except Exception as e:  # noqa: BLE001  a failed call counts as an answer that is not valid
                answers.append((domain, f"Error: {e}"))
        if not answers:
            break
        given = current.join(spark.createDataFrame(answers, "domain string, response string"), "domain")
        done |= {r.domain: {**r.asDict(), "attempts": attempt} for r in validate_revision(given).collect()}  # one row per domain
    return done


def calibrate(items: DataFrame, rubrics: DataFrame, raters: list[str], rater: Rater, reviser: Callable[..., str], log: str, tau: float = 0.8, max_iterations: int = 10, run_tag: str = "run", flagged: DataFrame | None = None, split_weight: float = 0.667, drop: float = 0.10, retries: int = 3, close_stagnated: bool = False) -> Calibration:
    """Label, measure, decide and revise until every domain has converged.

    A domain that reaches ``tau`` is converged: it is measured once more in the next iteration and then skipped, so no
    further calls are made for it.  If that one measurement is more than ``drop`` below the one before, the domain is
    open again and revised on.  A stagnated domain is measured on but not revised (``close_stagnated``: skipped too).
    ``reviser(domain, rubric, cases, changes)`` gets at most eight cases and the last three changes, and with the rubric
    the domain's ``agreement_history``, a value per iteration; items that it calls irreducible take no part from then on.  Items without a domain have no rubric and take no part at all.

    The driver holds one row per domain and iteration, the cases, and the irreducible items that revisers name."""
    spark = items.sparkSession
    names = spark.createDataFrame([(r,) for r in raters], "rater_id string")
    items = items.where(F.col("domain").isNotNull())
    domains = sorted(r.domain for r in items.select("domain").distinct().collect())  # configuration-sized
    current, rows, versions, changes, given_up = rubrics, [], [], [], []
    converged, recheck, closed = set(), set(), set()
    history = spark.createDataFrame([], HISTORY)
    for iteration in range(1, max_iterations + 1):
        wanted = [d for d in domains if d not in closed and (d not in converged or d in recheck)]
        if not wanted:
            break
        active = items.where(F.col("domain").isin(wanted))
        irreducible = spark.createDataFrame(given_up, "domain string, item_id long")
        for out in [flagged] * (flagged is not None) + [irreducible] * bool(given_up):
            active = exclude_items(active, out)
        tag = f"{run_tag}-{iteration}"
        plan = plan_calls(active, names, spark.createDataFrame([(str(iteration),)], "rubric_version string"), 1, tag)
        own = read_log(spark, log).where(F.col("run_tag") == tag)
        missing = written(pending_calls(plan, own), "pending-calls")  # keys only; counted from its files
        todo = joined(missing, active, ["domain", "item_id"])
        append_calls(label_items(attach_rubric(todo, current.drop("version")), rater, calls=missing.count()), log)
        ratings = read_log(spark, log).where(F.col("run_tag") == tag)
        values = {r.domain: r for r in panel_metrics(ratings, split_weight=split_weight).collect()}
        known = {r.domain: r for r in current.collect()}
        before = {r[0]: r[2] for r in rows}
        rows += [(d, iteration, v.weighted, v.all_agree, known[d].version if d in known else None) for d, v in sorted(values.items())]
        versions.append(current)
        history = spark.createDataFrame(rows, HISTORY)
        stagnated = {r.domain for r in h.stagnation_flag(history).where((F.col("iteration") == iteration) & F.col("stagnated")).collect()}
        checked, recheck, open_ = recheck, set(), []
        for d, v in sorted(values.items()):
            if d in checked and round(before[d] - v.weighted, 12) > drop:
                converged.discard(d)
            elif v.weighted >= tau and d not in converged:
                converged.add(d)
                recheck.add(d)
            if d in converged:
                continue
            if d in stagnated:
                closed |= {d} if close_stagnated else set()
            else:
                open_.append(d)
        if iteration == max_iterations or not open_:
            continue
        panel = panel_vote(ratings, details=True).where(F.col("domain").isin(open_) & ~F.col("all_agree"))
        cases = [c.asDict() for c in disagreement_cases(top_cases(panel), active).collect()]
        own_cases = {d: [c for c in cases if c["domain"] == d] for d in open_ if d in known}
        measured = {d: [r[2] for r in rows if r[0] == d] for d in own_cases}
        asked = {d: ({**known[d].asDict(), "agreement_history": measured[d]}, found, [c for c in changes if c["domain"] == d][-3:]) for d, found in own_cases.items() if found}
        revised = revise(current, asked, reviser, retries)
        for d, r in sorted(revised.items()):
            if r["success"]:
                changes.append({"domain": d, "iteration": iteration, "agreement_before": values[d].weighted, "reasoning": r["reasoning"], "diagnosis": r["diagnosis"]})
                given_up += [(d, x) for x in r["irreducible"] if (d, x) not in given_up]
        current = spark.createDataFrame([tuple((revised.get(r.domain) or r.asDict())[c] for c in rubrics.columns) for r in known.values()], rubrics.schema)
    best = {r.domain: r.iteration for r in h.best_iteration(history).collect()}
    chosen = [r for i, v in enumerate(versions, 1) for r in v.collect() if best.get(r.domain) == i]
    log_ = spark.createDataFrame([tuple(c.values()) for c in changes], "domain string, iteration int, agreement_before double, reasoning string, diagnosis string")
    irreducible = spark.createDataFrame(given_up, "domain string, item_id long")
    return Calibration(history, spark.createDataFrame(chosen, rubrics.schema), log_, irreducible, h.calibration_summary(history, tau, drop, log_, irreducible))
