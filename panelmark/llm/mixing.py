"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / weight`` from a hash of its id, with its quality as the weight.
Within a source the documents stand in key order and a prefix sum of their sizes meets the source's budget: complete
epochs of the whole source come first, and the keys decide only who belongs to the last, fractional one.

The prefix sum has two levels so that no source is one group: keys are cut into slices of equal width, ``PER_UNIT`` to
one, slice totals are summed within the source, and rows are ordered only within (source, slice).  Documents of weight w
have keys of density w at most, so a slice holds no more than the ``w / PER_UNIT``-th part of a source, whatever the mix
of weights; keys below 2 ** 32 documents' largest, 23 / w, make a bounded number of slices.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its own, the last; a null
doc_id draws the key of an empty string; rows with equal keys stand in order of id and size, so repeated rows get the
same set of results in any run.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.llm.common import stored, table, unused, words

WEIGHTS = (5, 2, 1)
#: Slices of the keys in an interval of length 1.
PER_UNIT = 1000


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_percent: int = 150, cap: int = 2) -> DataFrame:
    """Targets per source from (source, source_size): shares by weight, none above ``cap`` times its size, the excess
    given to the others.  The share per unit of weight is found in closed form: with the sources in order of cap per
    weight it is the first level that the next source's cap does not stop.  One row per source: the mix's
    configuration, not data."""
    rank = W.orderBy(F.col("source").isNull(), F.col("source"))
    pattern = F.array(*(F.lit(float(x)) for x in weights))
    s = sizes.withColumn("w", F.element_at(pattern, ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everyone) * F.lit(total_percent / 100.0))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.row_number().over(order).alias("k"), F.col("level").alias("level")))).over(everyone).level)
    return s.select("source", "source_size", F.least(F.col("most"), F.col("level") * F.col("w")).alias("target"))


def sampling_key(doc_id, weight):
    """Exponential key: u from 32 bits of a hash of the id, never 0."""
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|mix"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return -F.log(u) / weight


def key_slice(key):
    return F.floor(key * PER_UNIT).cast("int")


def quality_weight(text):
    """Share of the characters that are not digits or markup symbols, at least 0.1."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(t, r"[0-9#*$%&|<>{}=_~^]+", ""))
    return F.greatest(F.lit(0.1), plain / F.greatest(F.length(t), F.lit(1)))


def mix(docs: DataFrame, size: str, weight: str, doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, total_percent: int = 150, cap: int = 2) -> DataFrame:
    """Add source_size, target, epochs (whole passes), part (words of the fractional pass) and taken.

    ``docs`` should be narrow: every row goes through one shuffle by (source, slice of the keys).  If it has a column of
    such a name, the new one gets underscores behind its name."""
    key = sampling_key(F.col(doc_id), F.col(weight))
    s = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(source).alias("of"), F.col(doc_id).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    s = s.withColumn("slice", key_slice(F.col("key")))
    slices = s.groupBy("of", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy(F.col("of").alias("source")).agg(F.sum("slice_size").alias("source_size")), weights, total_percent, cap)
    before = W.partitionBy("of").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("offset", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    plan = slices.join(targets, F.col("of").eqNullSafe(F.col("source"))).select(F.col("of").alias("plan_of"), F.col("slice").alias("plan_slice"), "offset", "source_size", "target")
    joined = s.join(plan, F.col("of").eqNullSafe(F.col("plan_of")) & (F.col("slice") == F.col("plan_slice")))
    within = W.partitionBy("of", "slice").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("place", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = joined.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    joined = joined.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("place"))).cast("long"))
    joined = joined.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
    return joined.select("row.*", *(F.col(c).alias(unused(docs, c)) for c in ("source_size", "target", "epochs", "part", "taken")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents; ``taken`` counts the words of the whole epochs and of the fractional one."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), quality_weight(F.col("text")).alias("weight"))
    # Stored, so that sizes and weights are taken from the texts once and not for each of the two passes.
    return mix(stored(narrow, "mix-sizes"), "size", "weight").select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
             -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)
               / greatest(0.1::DOUBLE, length(regexp_replace(t, '[0-9#*$%&|<>{}=_~^]+', '', 'g'))::DOUBLE / greatest(length(t), 1)::DOUBLE) AS k
      FROM d),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
b AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS most,
             sum(source_size) OVER () * 1.5::DOUBLE AS total FROM a),
c AS (SELECT *, row_number() OVER o AS n, (total - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM b WINDOW o AS (ORDER BY most / w, source NULLS LAST)),
l AS (SELECT level AS found FROM c WHERE level <= most / w ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, least(most, found * w) AS target FROM c CROSS JOIN l),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, round(target - epochs * source_size)::BIGINT - place)))::BIGINT AS taken
FROM p
"""
