"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing to target weights, packing.

Each stage takes all rows that the one before kept and is written as Parquet; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import unused, words
from panelmark.llm.mixing import mix, quality_weight
from panelmark.llm.near_dup import near_duplicates
from panelmark.llm.packing import pack_documents
from panelmark.llm.quality import quality_cascade
from panelmark.llm.substrings import remove_repeats
from panelmark.llm.tokens import vocabulary
from panelmark.sources.shared import shared_path

#: Words of a passage that the substring stage removes where it repeats.
PASSAGE = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  A null or empty text has too few words and goes; an empty table stays
    empty."""
    judged = quality_cascade(docs)
    return judged.where(F.col(judged.columns[-1]).isNull()).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows are told apart by id and text; of rows equal in both, one stays.  Documents without words are no duplicates of
    anything and stay; a null id counts as greater than any other."""
    found = near_duplicates(docs, k=5, percent=80)
    id_, hash_ = unused(docs, "kept_id"), unused(docs, "kept_hash")
    keep = found.where(F.col("node") == F.col("lead")).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    on = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_))
    kept = docs.join(keep.distinct(), on, "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut; documents left without a word go.  Texts
    without words stay as they are (null stays null, with its n_chars); a null id is later than any other."""
    cut = remove_repeats(docs, length=PASSAGE)
    n, gone = (F.col(c) for c in cut.columns[-3:-1])
    length = F.when(gone > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.where((gone < n) | (n == 0)).withColumn("n_chars", length).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target asks: whole epochs, then whole documents of the fractional one
    (the document at the budget's end if at least half of it fits).  Documents without words are taken as often as the
    whole epochs ask; a null source is a source of its own."""
    n_words = F.size(words(F.col("text"))).cast("long")
    sized = docs.select("doc_id", "source", n_words.alias("n_words"), quality_weight(F.col("text")).alias("weight"), F.struct(*docs.columns).alias("whole"))
    mixed = mix(sized, "n_words", "weight")
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("n_words")), 1).otherwise(0)
    return mixed.select("whole", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("copy")).select("whole.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents in sequences of at most 2048 tokens; a text without words is one token, its end."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("repeated passages", substring_dedup),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

#: SQL can't tokenize.  The tests hold every stage's rows against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
