"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more component so that all have the length of the longest; then the largest inner product is the
smallest distance.  Every vector is keyed by its nearest pivot and its distance to it; each pivot's distances are cut
into annuli.  Of an annulus the index knows the least and largest distance of its vectors to every pivot and their
largest norm, and so a bound on the score that it can hold for a query (triangle inequality, Cauchy-Schwarz).

A query expands its annuli in order of their bounds, in rounds of ``WIDTHS``: after each round its k-th score so far is
the floor, which only rises, and the query stops at the first annulus whose bound is below it.  Scores are exact
integers; distances only decide what is skipped, with a margin for rounding.

Pivots and cuts come from at most ``SAMPLE`` rows (they change the work, never the result); the index holds every row.
Their counts are fixed, so the table of annuli that workers get is bounded.  Annuli are cut into blocks of about
``BLOCK`` vectors and ``QUERIES`` queries, the unit of a task's memory.

Defined results: vectors that are null or hold a null, NaN or infinite component (also one that 256 makes infinite) take
no part; a score beyond a long is the nearest long, and so a tie; shorter vectors count as
followed by zeros; rows that repeat a vec_id are candidates of their own (also for each other), a query per row; ties
go to the smaller vec_id; a null vec_id is no query and, as candidate, the last of its ties; fewer candidates than k
give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.llm.common import discard, stored, table

SAMPLE, PIVOTS, RINGS, BLOCK, QUERIES = 2048, 32, 8, 8192, 8192
#: Annuli that a query expands in each round; the last round takes the rest.
WIDTHS = (2, 14, 48)
LAST = (1 << 63) - 1
ROW = "row long, vec_id long, ring int, near double, norm double, packed binary"
#: Squared lengths below this have exact scores in doubles.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, v, norm): integer vectors of the rows that take part."""
    e = F.col(embedding)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    times = lambda x: F.lit(256.0) * x.cast("double")
    v = F.transform(e, lambda x: F.when(F.abs(times(x)) < float(1 << 52), F.floor(times(x)).cast("double")).otherwise(times(x)))
    part = vectors.where(e.isNotNull()).where(~odd).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    part = part.where(~F.exists("v", lambda x: F.abs(x) == float("inf")))
    return part.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", norm.alias("norm"))


@dataclass(frozen=True)
class Shape:
    """Width of the vectors, bytes of a packed component, factor that keeps squares of components small, longest squared
    length (with the factor), and whether scores are exact in doubles."""

    width: int
    dtype: str
    scale: float
    most: float
    exact: bool

    @classmethod
    def of(cls, width: int, largest: float, norm: float) -> Shape:
        if norm < EXACT:
            return cls(width, "f4" if largest < 1 << 24 else "f8", 1.0, norm, True)
        scale = 2.0 ** -math.frexp(largest)[1]
        return cls(width, "f8", scale, float(width), False)

    def packed(self, v) -> bytes:  # noqa: ANN001
        return np.asarray(v, self.dtype).tobytes()

    def matrix(self, packed) -> np.ndarray:  # noqa: ANN001
        """Rows of packed vectors, of one width or shorter, times the factor."""
        out = np.zeros((len(packed), self.width))
        for i, x in enumerate(packed):
            v = np.frombuffer(x, self.dtype)
            out[i, : len(v)] = v
        return out * self.scale if self.scale != 1.0 else out


def lifted(m: np.ndarray, most: int) -> np.ndarray:
    """With the component that makes all lengths equal."""
    return np.c_[m, np.sqrt(np.maximum(most - (m * m).sum(axis=1), 0))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def pivots_of(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots far from each other, moved once to the mean of their own; quantiles of each pivot's distances."""
    chosen, least = [0], None
    while len(chosen) < min(PIVOTS, len(sample)):
        d = distances(sample, sample[chosen[-1:]])[:, 0]
        least = d if least is None else np.minimum(least, d)
        chosen.append(int(least.argmax()))
    own = distances(sample, sample[chosen]).argmin(axis=1)
    pivots = np.array([sample[own == p].mean(axis=0) if (own == p).any() else sample[c] for p, c in enumerate(chosen)])
    d = distances(sample, pivots)
    own, near = d.argmin(axis=1), d.min(axis=1)
    cuts = [np.quantile(near[own == p], np.arange(1, RINGS) / RINGS) if (own == p).any() else np.zeros(RINGS - 1) for p in range(len(pivots))]
    return pivots, np.array(cuts)


def _keyed(pivots: np.ndarray, cuts: np.ndarray, shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shape.packed(x.values.to_numpy()) for x in batch.column("v")]
            d = distances(lifted(shape.matrix(packed), shape.most), pivots)
            own = d.argmin(axis=1)
            near = d.min(axis=1)
            ring = own * RINGS + (near[:, None] > cuts[own]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(ring, pa.int32()), pa.array(near), batch.column("norm"), pa.array(packed, pa.binary())], ["row", "vec_id", "ring", "near", "norm", "packed"])

    return run


def _spread(pivots: np.ndarray, shape: Shape):
    """Least and largest distance to every pivot and largest norm, per ring of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring, norm = batch.column("ring").to_numpy(), batch.column("norm").to_numpy()
            d = distances(lifted(shape.matrix(batch.column("packed").to_pylist()), shape.most), pivots)
            order = np.argsort(ring, kind="stable")
            at = np.flatnonzero(np.r_[np.ones(min(len(ring), 1), bool), np.diff(ring[order]) != 0])
            if not len(at):
                continue
            low, high, norms = np.minimum.reduceat(d[order], at), np.maximum.reduceat(d[order], at), np.maximum.reduceat(norm[order], at)
            n, p = low.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ring[order][at], p), pa.int32()), pa.array(np.tile(np.arange(p), n), pa.int32()), pa.array(low.ravel()), pa.array(high.ravel()), pa.array(np.repeat(norms, p), pa.float64())], ["ring", "pivot", "low", "high", "norm"])

    return run


class Annuli:
    """Bounds on the scores of the annuli for any queries."""

    def __init__(self, pivots: np.ndarray, rows: list, shape: Shape) -> None:  # noqa: ANN001
        self.pivots, self.most, self.exact = pivots, shape.most, shape.exact
        self.rings = np.array(sorted({r.ring for r in rows}), int)
        at = {r: i for i, r in enumerate(self.rings.tolist())}
        self.low, self.high = np.zeros((len(self.rings), len(pivots))), np.zeros((len(self.rings), len(pivots)))
        self.norm = np.zeros(len(self.rings))
        for r in rows:
            self.low[at[r.ring], r.pivot], self.high[at[r.ring], r.pivot], self.norm[at[r.ring]] = r.low, r.high, r.norm

    def best(self, queries: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """No score of the ring (column) exceeds this for the query (row)."""
        if not self.exact:
            return np.full((len(queries), len(self.rings)), np.inf)
        d = distances(lifted(queries, 0), self.pivots)
        gap = np.zeros((len(d), len(self.rings)))
        for p in range(d.shape[1]):
            own = d[:, p : p + 1]
            np.maximum(gap, np.maximum(own - self.high[:, p], self.low[:, p] - own), out=gap)
        score = np.minimum((norm[:, None] + self.most - gap**2) / 2, np.sqrt(norm[:, None] * self.norm))
        return score + 1 + 1e-9 * (self.most + np.abs(score))


def _expanded(annuli: Annuli, shape: Shape, start: int, count: int):
    """(ring, query) of the annuli at places [start, start + count) of a query's order, as far as the floor allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = annuli.best(shape.matrix(batch.column("packed").to_pylist()), batch.column("norm").to_numpy())
            order = np.argsort(-best, axis=1, kind="stable")[:, start : start + count]
            rows, at = np.nonzero(np.take_along_axis(best, order, axis=1) >= batch.column("floor").to_numpy()[:, None])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(annuli.rings[order[rows, at]], pa.int32()), *(batch.column(c).take(take) for c in ("row", "packed", "floor"))], ["ring", "query", "packed", "floor"])

    return run


def whole_score(a: list[float], b: list[float]) -> int:
    """Inner product of whole numbers, or the nearest long."""
    return max(-LAST - 1, min(LAST, sum(int(x) * int(y) for x, y in zip(a, b, strict=False))))


def _scores(shape: Shape, k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:  # noqa: ANN001
        names = ["query", "row", "vec_id", "score"]
        out = {c: [] for c in names}
        if left.num_rows and right.num_rows:
            packed = left.column("packed").to_pylist()
            v, rows, ids = shape.matrix(packed), left.column("row").to_numpy(), left.column("vec_id").to_pylist()
            order_ids = np.array([LAST if x is None else x for x in ids])
            lengths = np.sqrt((v * v).sum(axis=1))
            for at in range(0, right.num_rows, 256):
                part = right.slice(at, 256)
                asked = part.column("packed").to_pylist()
                m = shape.matrix(asked)
                near = m @ v.T
                for i, (q, floor) in enumerate(zip(part.column("query").to_pylist(), part.column("floor").to_pylist(), strict=True)):
                    good = np.flatnonzero(rows != q)
                    if shape.exact:
                        s = np.rint(near[i]).astype(np.int64)
                    else:
                        error = 1e-12 * np.sqrt((m[i] * m[i]).sum()) * lengths
                        if len(good) > k:  # what may be among the best, ties of saturated scores included
                            low = np.sort((near[i] - error)[good])[-k]
                            last = LAST * shape.scale * shape.scale
                            if low >= -last:  # else all below a long are ties
                                good = good[(near[i] + error)[good] >= min(low, last)]
                        s = np.zeros(len(rows), np.int64)
                        own = np.frombuffer(asked[i], shape.dtype).tolist()
                        s[good] = [whole_score(own, np.frombuffer(packed[j], shape.dtype).tolist()) for j in good.tolist()]
                    good = good[s[good] >= floor]
                    if len(good) > k:
                        good = good[np.lexsort((rows[good], order_ids[good], ~s[good]))[:k]]
                    out["query"] += [q] * len(good)
                    out["row"] += rows[good].tolist()
                    out["vec_id"] += [ids[j] for j in good]
                    out["score"] += s[good].tolist()
        return pa.table({c: pa.array(out[c], pa.int64()) for c in names})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", scored: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all rows.

    ``scored``, a list, gets the number of (query, vector) pairs that each round scored, for one more job a round."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    base = stored(quantised(vectors, vec_id, embedding), "search-vectors")
    sizes = base.agg(F.max(F.size("v")), F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0.0))), F.max("norm")).first()
    if sizes[0] is None:
        return empty
    shape = Shape.of(max(sizes[0], 1), sizes[1], sizes[2])
    sample = base.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("v").collect()
    pivots, cuts = pivots_of(lifted(shape.matrix([shape.packed(r.v) for r in sample]), shape.most))
    index = stored(base.mapInArrow(_keyed(pivots, cuts, shape), ROW), "search-index")
    sizes = {r[0]: (r[1], r[2]) for r in index.groupBy("ring").agg(F.count(F.lit(1)), F.sum(F.when(F.col("vec_id") % every == 0, 1).otherwise(0))).collect()}  # PIVOTS x RINGS rows at most
    spread = index.select("ring", "norm", "packed").mapInArrow(_spread(pivots, shape), "ring int, pivot int, low double, high double, norm double")
    annuli = Annuli(pivots, spread.groupBy("ring", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")).collect(), shape)  # PIVOTS times as many
    blocks = F.create_map(*(F.lit(int(x)) for ring, (n, _) in sizes.items() for x in (ring, -(-n // BLOCK))))
    turns = max(1, -(-sum(q for _, q in sizes.values()) // QUERIES))
    queries = index.where(F.col("vec_id") % every == 0)
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    found, start = None, 0
    for count in (*WIDTHS, len(annuli.rings)):
        asked = queries.withColumn("floor", F.lit(-LAST - 1))
        if found is not None:
            kth = found.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("kth"))
            asked = queries.join(kth, "row", "left").withColumn("floor", F.coalesce("kth", F.lit(-LAST - 1)))
        pairs = asked.select("row", "norm", "packed", "floor").mapInArrow(_expanded(annuli, shape, start, count), "ring int, query long, packed binary, floor long")
        pairs = pairs.withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(turns)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("ring")) - 1)))
        pairs = stored(pairs, "search-pairs")
        start += count
        wanted = pairs.select(F.col("ring").alias("wanted"), F.col("turn").alias("wanted_turn")).distinct()
        if scored is not None:
            scored.append(sum(r[1] * sizes[r[0]][0] for r in pairs.where("block = 0").groupBy("ring").count().collect()))
        rows = index.join(wanted, F.col("ring") == F.col("wanted")).withColumn("turn", F.col("wanted_turn") + 0).withColumn("block", F.pmod(F.xxhash64("row"), F.element_at(blocks, F.col("ring"))).cast("int"))
        keys = ["ring", "turn", "block"]
        hits = rows.select(*keys, "row", "vec_id", "packed").groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(_scores(shape, k), "query long, row long, vec_id long, score long")
        known = hits if found is None else found.drop("rank").unionByName(hits)
        ranked = stored(known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "search-found")
        discard(pairs, *([found] if found is not None else []))
        found = ranked
        if start >= len(annuli.rings):
            break
    named = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(named, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of every fiftieth vector among all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""
