"""The call log as a bucketed table: what folds or looks up calls by item reads it without moving it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.operators.keys import unused
from panelmark.operators.pairs import CALL

COLUMNS = "run_tag string, domain string, rubric_version string, item_id long, rater_id string, repeat int, label string, confidence string, reason string, criterion_quote string"


class CallLog:
    """Calls in ``buckets`` by item, sorted by domain and item, at a path that a session names as a table.

    Buckets follow the item alone: every key of the log holds it, so votes of an item, its last calls, its pairs of raters
    and the calls still to make need no exchange of the log, whether a domain is null or not.  An append deals its rows
    to the buckets first and writes a file per bucket.  Another session opens the same path by the same constructor."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64, columns: str = COLUMNS) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (item_id) SORTED BY (domain, item_id) INTO {buckets} BUCKETS LOCATION '{path}'")

    def append(self, calls: DataFrame) -> None:
        rows = calls.select(*self.read().columns).repartition(self.buckets, "item_id")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "item_id").sortBy("domain", "item_id").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def pending(self, plan: DataFrame, key=CALL) -> DataFrame:
        """Calls of the plan that the log does not have.  The log is folded to the calls of each item where it lies, and
        only the plan is dealt to the buckets.  Null parts of a call equal each other; a call without an item is always
        pending."""
        done, item = unused(plan, "done"), unused(plan, "done_item")
        call = lambda: F.struct(*(F.col(k) for k in key))
        known = self.read().where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias(item)).agg(F.collect_set(call()).alias(done))
        both = plan.join(known, plan["item_id"] == F.col(item), "left")
        kept = both.where(~F.coalesce(F.exists(F.col(done), lambda c: _same(c, key)), F.lit(False)))
        return kept.select(*(plan[c] for c in plan.columns))


def _same(call, key):  # noqa: ANN001, ANN202
    out = F.lit(True)
    for k in key:
        out = out & call[k].eqNullSafe(F.col(k))
    return out
