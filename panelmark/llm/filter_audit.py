"""Audit of filters that remove the same documents: inclusion-exclusion over all intersections.

A document has a flag for each of five filters that it fails.  For every set of filters, the documents of a part that
fail all of it are counted as a sum of products of flags (32 joint counts, and as many for good and for toxic ones).
Everything else is arithmetic on these counts, whatever the order of the filters:

* survivors of a set of filters: the alternating sum of the joint counts of its subsets (Moebius inversion);
* removed at a step: survivors before less survivors after it; redundant: the filter's failures less those;
* failing one filter only: the alternating sum over the sets that hold it;
* Shapley value: a set's Harsanyi dividend, its joint count with the sign of inclusion-exclusion, in equal shares to its
  filters.  Times the number of orders that is what the filter removes, summed over all of them.

Documents are narrowed to (id, part, flags, digest of the text) in one scan and stored.  A text is a copy if its digest
(SHA-256) has a smaller id.  Digests and ids that hold more than a thousandth of all rows meet their partners by a
broadcast of at most a thousand rows, the others by a shuffle, so no hot text or id lands in one task.

Defined results: a null text is an empty text, a null part the empty string; rows that repeat an id are judged alike
(they are no copies of each other); a null id is no copy, has no labels and makes no other row a copy; of several label
rows of an id one that says so is enough; an empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import let, stored, table, words

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
_SETS = range(1 << len(FILTERS))
#: A key with more than this part of all rows is hot, so there are at most as many hot keys as its reciprocal.
HOT = 1000


def text_flags(text: Column) -> Column:
    """Bit i is set if the text fails filter i (A to D)."""
    t = F.coalesce(text, F.lit(""))
    found = words(text)
    fails = (
        F.size(found) < 200,
        100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 2 * F.length(t),
        t.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(bad, F.lit(1 << i)).otherwise(0) for i, bad in enumerate(fails)), F.lit(0))


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """Keys with more than a thousandth of all rows: fewer than ``HOT``."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * HOT > total).select(key)


def with_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join to ``right``, which has a key once.  Rows of the few hot keys take their partner from a broadcast; in
    the shuffle they and rows without a key are dealt out by a salt, and meet nothing."""
    values = [c for c in right.columns if c != key]
    few = hot.join(right, key, "left").select(F.col(key).alias("hot_key"), F.struct(*values).alias("hot_row"))
    rest = right.select(F.col(key).alias("cold_key"), F.lit(0).alias("cold_salt"), F.struct(*values).alias("cold_row"))
    out = left.join(F.broadcast(few), F.col(key) == F.col("hot_key"), "left")
    out = out.withColumn("salt", F.when(F.col("hot_key").isNotNull() | F.col(key).isNull(), F.monotonically_increasing_id() % 4093 + 1).otherwise(0).cast("int"))
    out = out.join(rest, (F.col(key) == F.col("cold_key")) & (F.col("salt") == F.col("cold_salt")), "left")
    return out.select(*left.columns, *(F.coalesce(F.col("hot_row").getField(c), F.col("cold_row").getField(c)).alias(c) for c in values))


def failure_patterns(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """How many documents of a part fail which filters: (part, flags, good, toxic, n)."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_flags(F.col(text)).alias("flags"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"))
    rows = stored(narrow, "audit-rows")
    total = rows.count()
    groups = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"), "audit-groups")
    hot = groups.where(F.col("n") * HOT > total).select("digest")
    copy = F.when(F.col("id") > F.col("first"), 1 << COPY).otherwise(0)
    judged = with_unique(rows, groups.select("digest", "first"), "digest", hot).select("id", "part", (F.col("flags") + copy).alias("flags"))
    judged = stored(judged, "audit-judged")
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    full = with_unique(judged, known, "id", hot_keys(judged, "id", total))
    no = F.lit(False)
    return full.groupBy("part", "flags", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def joint_counts(patterns: DataFrame) -> DataFrame:
    """Per part the documents that fail all filters of a set, by the set's number: all, good and toxic ones."""
    product = lambda s, of: F.sum(F.when(F.col("flags").bitwiseAND(s) == s, of).otherwise(0))
    of = {"failing": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    return patterns.groupBy("part").agg(*(F.array(*(product(s, c) for s in _SETS)).alias(name) for name, c in of.items()))


def survivors(joint: Column) -> Column:
    """Documents that no filter of a set removes, by the set's number: sums over subsets, with alternating signs."""
    out = F.zip_with(joint, F.array(*(F.lit((-1) ** s.bit_count()) for s in _SETS)), lambda n, sign: n * sign)

    def added(bit: int):
        return lambda sums: F.transform(sums, lambda v, s: v + F.when(s.bitwiseAND(bit) > 0, F.get(sums, s - bit)).otherwise(0))

    for i in range(len(FILTERS)):
        out = let(out, added(1 << i))
    return out


def shapley(joint: Column) -> Column:
    """What each filter removes, summed over all orders: its shares of the dividends of the sets that hold it."""
    orders = 1
    for i in range(2, len(FILTERS) + 1):
        orders *= i
    share = lambda s: F.get(joint, F.lit(s)) * ((-1) ** (s.bit_count() + 1) * (orders // s.bit_count()))
    return F.array(*(sum((share(s) for s in _SETS if s >> i & 1), F.lit(0)) for i in range(len(FILTERS))))


def filter_interactions(patterns: DataFrame) -> DataFrame:
    """Every step of every order of the filters, per part."""
    joint = joint_counts(patterns)
    known = joint.select("part", "failing", shapley(F.col("failing")).alias("worth"), *(survivors(F.col(c)).alias(f"left_{c}") for c in ("failing", "good", "toxic")))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = known.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*(F.lit(i + 1) for i in range(len(FILTERS))))))
    number = F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")) - 1
    earlier = sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"filter_number": number, "earlier": earlier}).withColumn("bit", F.expr("shiftleft(1, filter_number)"))
    all_sets = F.lit(len(_SETS) - 1)
    lost = lambda c: F.get(f"left_{c}", F.col("earlier")) - F.get(f"left_{c}", F.col("earlier") + F.col("bit"))
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        F.get("left_failing", F.col("earlier") + F.col("bit")).alias("kept"),
        lost("failing").alias("removed"),
        (F.get("failing", F.col("bit")) - lost("failing")).alias("redundant"),
        (F.get("left_failing", all_sets - F.col("bit")) - F.get("left_failing", all_sets)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("worth", F.col("filter_number")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by source."""
    return filter_interactions(failure_patterns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             map {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
                  'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first, false)} AS fails
      FROM d JOIN f USING (text) LEFT JOIN l ON d.doc_id = l.doc_id),
p AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
r AS (SELECT *, list_position(list_transform(string_split(filter_order, ''), lambda c: fails[c]), true) AS gone FROM p, o),
k AS (SELECT part, filter_order, step, filter_order[step] AS filter,
             sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN gone < step AND fails[filter_order[step]] THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN fails[filter_order[step]] AND len(list_filter(map_values(fails), lambda v: v)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN gone = step AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM r, (SELECT unnest(range(1, 6))::INTEGER AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM k
"""
