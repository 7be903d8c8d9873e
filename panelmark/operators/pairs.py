"""Joins and set operations on label sets, items and calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.functions.text import let, normalize_text
from panelmark.operators.keys import joined, unused
from panelmark.operators.votes import ITEM
from panelmark.sources.shared import written

CALL = ("run_tag", "domain", "rubric_version", "item_id", "rater_id", "repeat")


def pair_labels(a: DataFrame, b: DataFrame, on=ITEM) -> DataFrame:
    """(on, label_a, label_b) of the keys that both have; null keys equal each other, here and in all joins below."""
    left = a.select(*on, F.col("label").alias("label_a"))
    return joined(left, b.select(*on, F.col("label").alias("label_b")), on)


def pair_many(target: DataFrame, refs: dict[str, DataFrame], on=ITEM) -> DataFrame:
    """(ref, label_a, label_b) against several references: one tagged union and one join, so the target moves once."""
    tagged = reduce(DataFrame.unionByName, [r.select(*on, F.col("label").alias("label_b"), F.lit(name).alias("ref")) for name, r in refs.items()])
    return joined(target.select(*on, F.col("label").alias("label_a")), tagged, on).select("ref", *on, "label_a", "label_b")


def missing_keys(ref: DataFrame, sets: dict[str, DataFrame], on=ITEM) -> DataFrame:
    """(set, key) of the reference's keys that a set lacks."""
    keys = ref.select(*on).distinct()
    return reduce(DataFrame.unionByName, [joined(keys, s.select(*on), on, "left_anti").withColumn("label_set", F.lit(name)) for name, s in sets.items()])


def require_complete(ref: DataFrame, sets: dict[str, DataFrame], on=ITEM) -> None:
    found = missing_keys(ref, sets, on).limit(5).collect()
    if found:
        raise ValueError(f"label sets lack keys, e.g. {[r.asDict() for r in found]}")


def plan_calls(items: DataFrame, raters: DataFrame, versions: DataFrame, repeats: int = 1, run_tag: str = "run") -> DataFrame:
    """Every call to make.  Raters and versions are configuration (a few rows each); items are exploded by the whole
    small grid, so nothing is shuffled."""
    grid = raters.select("rater_id").join(versions.select("rubric_version")).agg(F.array_sort(F.collect_list(F.struct("rubric_version", "rater_id"))).alias("grid"))
    cells = items.select(*ITEM).join(F.broadcast(grid)).withColumn("cell", F.explode("grid"))
    out = cells.select(F.lit(run_tag).alias("run_tag"), *ITEM, "cell.rubric_version", "cell.rater_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    return out.select(*CALL)


def pending_calls(plan: DataFrame, log: DataFrame, key=CALL) -> DataFrame:
    """Calls that the log does not have; a call without a domain is done once the log has it."""
    return joined(plan, log.select(*key), key, "left_anti")


def attach_rubric(items: DataFrame, rubrics: DataFrame) -> DataFrame:
    """One rubric per domain: a configuration table, broadcast so that texts are not shuffled by domain.  Items without a
    rubric stay."""
    return joined(items, F.broadcast(rubrics), ["domain"], "left")


def verify_alignment(a: DataFrame, b: DataFrame, on=ITEM, text: str = "text") -> DataFrame:
    """Positions whose trimmed texts differ or that one side lacks; hashes are compared, texts do not move.  A null text
    equals a null text only."""
    side = lambda df, name: df.select(*on, F.sha2(F.trim(text), 256).alias(name))
    mark = lambda df, name: side(df, name).withColumn(f"has_{name}", F.lit(True))
    both = joined(mark(a, "hash_a"), mark(b, "hash_b"), on, "full")
    problem = F.when(F.col("has_hash_a").isNull(), "missing_a").when(F.col("has_hash_b").isNull(), "missing_b").when(~F.col("hash_a").eqNullSafe(F.col("hash_b")), "text")
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*on, "problem")


def attach_cluster(labels: DataFrame, clusters: DataFrame, on=ITEM) -> DataFrame:
    return joined(labels, clusters.select(*on, "cluster_id"), on)


#: Slices (their anchors, eight to twelve times as many) that are broadcast; with more, both sides are shuffled.
BROADCAST_SLICES = 200_000
#: Parts into which the items of each anchor are dealt where they are shuffled.
SALTS = 16
#: Texts in which anchors are counted.
COUNTED = 4096


def _grams(words: Column, by: list[Column], lengths: list[int], body) -> Column:  # noqa: ANN001
    """``body`` of the arrays of hashes of all runs of one word, two, four, ... up to the longest needed.  A run's hash is
    that of its halves' hashes, so each length is one pass over an array of numbers."""

    def doubled(known: list[Column], n: int) -> Column:
        if n >= max(lengths, default=1):
            return body(dict(zip((1 << i for i in range(len(known))), known, strict=True)))
        last = known[-1]
        size = F.greatest(F.size(last) - n, F.lit(0))
        return let(F.zip_with(F.slice(last, 1, size), F.slice(last, n + 1, size), lambda x, y: F.xxhash64(x, y)), lambda x: doubled([*known, x], 2 * n))

    return let(F.transform(words, lambda w: F.xxhash64(*by, w)), lambda x: doubled([x], 1))


def _pieces_of(word: Column, n: Column, by: list[Column]) -> Column:
    """Hashes of all runs of n characters of a word."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.xxhash64(*by, F.substring(word, i, n)))


def link_by_excerpt(probes: DataFrame, items: DataFrame, start: int = 50, length: int = 100, by=("domain",), normalized: bool = True, anchor_words: int = 8, anchor_chars: int = 16) -> DataFrame:
    """(probe_id, item_id): the first item of the same group whose text holds a slice of the probe's text.

    Slices and texts meet on anchors, never all with all: hashes of ``anchor_words`` (a power of two) whole words, or half
    as many, a quarter, ... down to one, if a slice has fewer between its cut ends; a slice without a whole word takes
    characters of its longest piece, which lies inside one word of a text.  The anchors of all slices are counted in a
    random sample of about ``COUNTED`` whole texts, and each slice then looks for its rarest only (the sample decides the
    work, never the result).

    Different slices, with their groups, are counted.  Up to ``BROADCAST_SLICES`` of them are broadcast: texts' anchors
    that no slice has are dropped in the scan, texts are compared where they lie, and nothing of them is shuffled, so a
    common anchor is no hot key.  With more slices the texts' anchors are shuffled without the texts, those of one anchor
    dealt to ``SALTS`` parts, and texts are fetched by item for the pairs that met.

    A slice of blanks has no anchor: its first item comes from an aggregation over the texts.  Null groups equal each
    other; null texts and empty slices never match; an item's first is the smallest ``item_id``."""
    norm = (lambda c: normalize_text(c)) if normalized else (lambda c: c)
    keyed = probes.select(*by, "probe_id", F.substring(norm(F.col("text")), start + 1, length).alias("slice")).where(F.length("slice") > 0)
    keyed = written(keyed, "excerpt-probes")
    group = [F.col(c) for c in by]
    lengths = [anchor_words >> i for i in range(anchor_words.bit_length())]
    pieces = F.split(F.col("slice"), " ")
    cut = keyed.select(*by, "slice").distinct()
    cut = cut.withColumn("inner", F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))))
    cut = cut.withColumn("words", F.coalesce(*(F.when(F.size(F.array_remove("inner", "")) >= n, n) for n in lengths), F.lit(0)))
    cut = cut.withColumn("piece", F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))).x)
    cut = cut.withColumn("chars", F.when(F.col("words") == 0, F.least(F.length("piece"), F.lit(anchor_chars))).otherwise(0))
    own = _grams(F.array_remove("inner", ""), group, lengths, lambda h: F.coalesce(*(F.when(F.col("words") == n, h[n]) for n in lengths)))
    letters = F.when(F.col("chars") > 0, _pieces_of(F.col("piece"), F.col("chars"), group))
    cut = written(cut.select(*by, "slice", "words", "chars", F.coalesce(own, letters, F.array().cast("array<bigint>")).alias("anchors")), "excerpt-slices")
    needed = cut.select("words", "chars").distinct().collect()  # as many as there are lengths
    n_words, n_chars = sorted({r.words for r in needed} - {0}), sorted({r.chars for r in needed} - {0})

    def bodies(df: DataFrame) -> DataFrame:
        """Texts without an entity stay clear of Python, and of the queue of rows that wait for it."""
        if not normalized:
            return df.select(*by, "item_id", F.col("text").alias("body")).where("body is not null")
        odd = F.col("text").contains("&")
        kept = lambda rows, unescape: rows.select(*by, "item_id", normalize_text(F.col("text"), unescape).alias("body"))
        return kept(df.where(~odd), False).unionByName(kept(df.where(odd), True))


    def letters_of(found: Column, n: int) -> Column:
        long = F.filter(F.array_distinct(found), lambda w: F.length(w) >= n)
        return F.flatten(F.transform(long, lambda w: _pieces_of(w, F.lit(n), group)))

    def anchors(found: Column) -> Column:
        whole = _grams(found, group, n_words, lambda h: F.concat(F.array().cast("array<bigint>"), *(h[n] for n in n_words)))
        parts = [letters_of(found, n) for n in n_chars]
        return F.array_distinct(F.concat(*([whole] if n_words else []), *parts) if n_words or parts else F.array().cast("array<bigint>"))

    few = cut.count() <= BROADCAST_SLICES
    held = F.broadcast if few else (lambda df: df)
    texts = bodies(items)
    grams_of = lambda df: bodies(df).withColumn("anchor", F.explode(let(F.array_remove(F.split("body", " "), ""), anchors)))
    grams = grams_of(items)
    names = ["slice", *(f"slice_{c}" for c in by)]
    sampled = min(1.0, COUNTED / max(items.count(), 1))
    asked = cut.select("slice", *(F.col(c).alias(f"slice_{c}") for c in by), F.explode(F.array_distinct("anchors")).alias("anchor"))
    counts = grams_of(items.sample(fraction=sampled, seed=3) if sampled < 1 else items).select("anchor").join(held(asked.select("anchor").distinct()), "anchor", "left_semi").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "anchor", "left").groupBy(*names).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("best"))
    chosen = written(rarest.select(*names, "best.anchor"), "excerpt-anchors")
    same = F.expr("contains(body, slice)")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"slice_{c}"))
    if few:
        pairs = grams.join(F.broadcast(chosen), "anchor")
    else:
        salted = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = grams.select(*by, "item_id", "anchor", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int").alias("salt"))
        met = dealt.join(salted, ["anchor", "salt"]).select(*by, "item_id", *names).distinct()
        pairs = joined(met, texts, [*by, "item_id"])
    first = pairs.where(same).groupBy(*names).agg(F.min("item_id").alias("item_id"))
    blanks = [r.slice for r in cut.where(F.size("anchors") == 0).select("slice").distinct().collect()]  # at most ``length``
    for blank in blanks:
        own = texts.where(F.col("body").contains(blank)).groupBy(*by).agg(F.min("item_id").alias("item_id"))
        first = first.unionByName(own.select(F.lit(blank).alias("slice"), *(F.col(c).alias(f"slice_{c}") for c in by), "item_id"))
    first = first.withColumnsRenamed({f"slice_{c}": c for c in by})
    return joined(keyed, first, [*by, "slice"]).select("probe_id", "item_id").groupBy("probe_id").agg(F.min("item_id").alias("item_id"))


def paired_versions(weights: DataFrame, v0: str, v1: str, on=ITEM, value: str = "weight", version: str = "rubric_version") -> DataFrame:
    """Difference v1 - v0 of the items that have both, by conditional aggregation instead of a self-join."""
    at = lambda v: F.max(F.when(F.col(version) == v, F.col(value)))
    out = weights.where(F.col(version).isin(v0, v1)).groupBy(*on).agg(at(v0).alias("before"), at(v1).alias("after"))
    return out.where("before is not null and after is not null").withColumn("difference", F.col("after") - F.col("before"))


def swap_rater(ratings: DataFrame, out: str, new: DataFrame, on=ITEM) -> DataFrame:
    """Ratings with one rater's labels replaced by ``new`` on the items that rater had."""
    its = F.col("rater_id").eqNullSafe(out)
    had = ratings.where(its).select(*on).distinct()
    names = [*on, "rater_id", "label"]
    return ratings.where(~its).select(*names).unionByName(joined(new, had, on, "left_semi").select(*names))


def exclude_items(items: DataFrame, flagged: DataFrame, on=ITEM) -> DataFrame:
    return joined(items, flagged.select(*on), on, "left_anti")


def dedup_against(candidates: DataFrame, existing: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """Candidates whose normalised text the corpus lacks, one (the smallest key) of each text.  Keys are found by hashes
    alone; candidates' rows are fetched once, for the keys that stay.  Null texts are no candidates."""
    mark = F.sha2(normalize_text(F.col(text), unescape=False), 256)
    old, new = unused(candidates, "in_corpus"), unused(candidates, "text_hash")
    both = candidates.select(mark.alias(new), F.col(key), F.lit(False).alias(old)).unionByName(existing.select(mark.alias(new), F.lit(None).cast(candidates.schema[key].dataType).alias(key), F.lit(True).alias(old)))
    first = both.where(F.col(new).isNotNull()).groupBy(new).agg(F.max(old).alias(old), F.min(key).alias(key)).where(~F.col(old)).select(key, new)
    return joined(candidates.withColumn(new, mark), first, [key, new], "left_semi").drop(new)


def pool_rounds(*cohorts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, cohorts)


def shared_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("cluster_id").intersect(b.select("cluster_id"))


def keys_minus(a: DataFrame, b: DataFrame, on=ITEM) -> DataFrame:
    """Keys of a that b lacks, as often as a has them more."""
    return a.select(*on).exceptAll(b.select(*on))


def common_items(*sets: DataFrame, on=ITEM) -> DataFrame:
    return reduce(DataFrame.intersect, [s.select(*on) for s in sets])


def top_cases(cases: DataFrame, n: int = 8) -> DataFrame:
    """The first n cases of each domain, in item order."""
    first = W.partitionBy("domain").orderBy("item_id")
    rank = unused(cases, "rank")
    return cases.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n).drop(rank)


def last_changes(log: DataFrame, n: int = 3) -> DataFrame:
    last = W.partitionBy("domain").orderBy(F.desc("iteration"))
    rank = unused(log, "rank")
    return log.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= n).drop(rank)
