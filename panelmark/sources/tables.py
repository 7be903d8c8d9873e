"""Readers and writers.  CSV with quoted line breaks cannot be split; land such files as Parquet first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUBRIC = "struct<version:string,domain_context:string,HIGH:array<string>,LOW:array<string>,conflict_rule:string>"
HUMAN = "domain string, round int, transcript_index long, item_id string, is_attention_check string, annotator_id string, included_in_consensus string, label string, confidence int, justification string"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header, doubled quotes, line breaks inside quotes; a byte-order mark is not part of the first name."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def boolean(name: str):  # noqa: ANN201
    """True/False in any case; anything else is null."""
    text = F.lower(F.trim(F.col(name)))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path).select("domain", F.col("transcript").alias("text"))


def read_items_jsonl(spark: SparkSession, path: str, pattern: str = r"([^/]+?)(?:_[^_/]*)?\.jsonl$") -> DataFrame:
    """One JSON object per line; the domain comes from the file's name; blank lines are no rows."""
    raw = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = raw.where(F.trim("value") != "").select(F.regexp_extract("file", pattern, 1).alias("domain"), F.from_json("value", "transcript string").alias("x"))
    return parsed.select("domain", F.col("x.transcript").alias("text"))


def read_rubrics(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of rubrics by domain as one row per domain; versions are strings."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{RUBRIC}>").alias("m"))
    return whole.select(F.explode("m").alias("domain", "r")).select("domain", "r.*")


def read_panel_labels(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    out = df.withColumn("item_id", F.col("transcript_index").cast("long")).drop("transcript_index")
    casts = {"agreement": "double", "votes_high": "int", "votes_low": "int"}
    out = out.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in df.columns})
    return out.withColumn("all_agree", boolean("all_agree")) if "all_agree" in df.columns else out


def panel_to_ratings(panel: DataFrame, columns: dict[str, str], item=("domain", "item_id")) -> DataFrame:
    """Wide labels to long ratings: ``columns`` maps label columns to rater ids."""
    named = panel.select(*item, *(F.col(c).alias(r) for c, r in columns.items()))
    return named.unpivot(list(item), list(columns.values()), "rater_id", "label")


def read_human_ratings(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, HUMAN)
    out = df.withColumns({c: boolean(c) for c in ("is_attention_check", "included_in_consensus")})
    return out.withColumn("item_id", F.col("transcript_index")).drop("transcript_index")


def read_batch_export(spark: SparkSession, path: str, question_prefix: str) -> DataFrame:
    """Rows whose question starts with the prefix, annotator columns unpivoted; empty answers are no ratings."""
    df = read_csv(spark, path)
    raters = [c for c in df.columns if c.startswith("Annotator") and c.endswith("_Response")]
    rows = df.where(F.col("Question").startswith(question_prefix)).select("transcript_id", "transcript", *raters)
    long = rows.unpivot(["transcript_id", "transcript"], raters, "rater_id", "answer")
    return long.withColumns({"rater_id": F.regexp_replace("rater_id", "_Response$", ""), "label": F.upper(F.trim("answer"))}).where(F.coalesce(F.trim("answer"), F.lit("")) != "").drop("answer")


def write_panel_labels(panel: DataFrame, ratings: DataFrame, raters: list[str], path: str, item=("domain", "item_id")) -> None:
    """The panel's row per item with one label column per rater."""
    wide = ratings.groupBy(*item).pivot("rater_id", raters).agg(F.first("label"))
    panel.join(wide.withColumnsRenamed({r: f"{r}_label" for r in raters}), list(item), "left").write.mode("overwrite").parquet(path)


def write_gold(gold: DataFrame, path: str, item=("domain", "item_id")) -> None:
    gold.orderBy(*item).write.mode("overwrite").option("header", True).csv(path)


def append_calls(calls: DataFrame, path: str) -> None:
    """Append to the call log, laid out so that a resumed run reads its own run and domains only."""
    calls.write.mode("append").partitionBy("run_tag", "domain").parquet(path)


def write_report(parts: DataFrame, path: str, keys=("domain",)) -> None:
    """A folder per section (``section`` column) of JSON rows, sorted by the keys over its files in order of their
    names.  Rows are dealt by ranges, so a section of any size takes as many tasks as it needs."""
    order = ["section", *keys]
    parts.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("section").json(path, ignoreNullFields=False)


def read_report(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """(section, columns) of a report."""
    found = spark.read.schema(f"section string, {columns}").json(path)
    return found.select("section", *(c for c in found.columns if c != "section"))
