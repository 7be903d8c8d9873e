"""Near-duplicate documents by circulant MinHash.

A shingle's hash is placed by one fixed permutation; one second permutation, read at circularly shifted places, gives
all signature coordinates: coordinate k of a set is the least pi((sigma(x) + k) mod 2^32) over its members.  Runs of
coordinates are bands.  Documents with the same set of shingles are one class, whatever their number; only one
representative of a class goes on.

Representatives that share a band are candidates.  No bucket is expanded into its pairs: first each member meets only
the best connected member of its bucket, candidates are verified on their full sets, and verified links are contracted
to components.  Buckets that still hold several components join these to families.  The members of a family are dealt
into blocks of at most about ``BLOCK`` bytes and ``BLOCK_ROWS`` rows, large components in blocks of their own.  Two blocks
meet in one task unless both are of one component, so a large group of copies that is linked already is not compared
with itself.  The task compares signatures as a matrix, verifies what they leave on the full sets and returns links only.
That finds the links that the first step had no reason to try; no pair is written or shuffled as a row.

The number of bands is chosen so that a pair exactly at the threshold shares none with a probability under 1e-5; the
signatures' last bits, compared in the blocks, turn such a pair away with one under 1e-7.  With ``exact`` a document's
buckets are instead the least hashes of its set, as many as it takes that two similar sets must share one (prefix
filter); no link is lost then, for more buckets.

Defined results: a document without words or text has no shingles, is linked with nothing and is its own component;
rows that repeat a doc_id are nodes of their own and share the smallest id of their component; a null doc_id is
greater than every other, and a component of such rows has a null component_id and all of them are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.llm.common import discard, gram_hashes, mixed, release, stored, table
from panelmark.llm.substrings import text_hashes

#: Coordinates of a signature, 256 at most.
COORDINATES = 240
#: Bytes of full sets and rows in a block; a task holds two blocks.
BLOCK, BLOCK_ROWS = 2 << 20, 256


def banding(percent: int, coordinates: int = COORDINATES, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the longest rows with which a pair at the threshold is missed less often than ``miss``."""
    for rows in range(16, 0, -1):
        bands = coordinates // rows
        if (1 - (percent / 100) ** rows) ** bands < miss:
            return bands, rows
    return coordinates, 1


def most_bits(percent: int, coordinates: int, miss: float = 1e-7) -> int:
    """Of the signatures' last bits, how many may differ: more do at the threshold with a probability under ``miss``.
    A bit differs if the coordinate does, half of the time."""
    p = (1 - percent / 100) / 2
    tail, d = 1.0, -1
    while tail >= miss and d < coordinates:
        d += 1
        tail -= math.comb(coordinates, d) * p**d * (1 - p) ** (coordinates - d)
    return d


#: A-Z in lower case; other letters are bytes from 0x80 on.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words are one shingle; no words, none."""
    h = text_hashes([text.encode().translate(_LOWER)])[0] if text else np.zeros(0, np.uint64)
    return np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else h


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set that isn't empty."""
    place = (mixed(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), 512):
        x = place[None, at : at + 512] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def prefix(found: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a sorted set: two sets of the similarity have one of these in common, for they share at least
    that percentage of the larger one's members and both keep the same order."""
    n = len(found)
    return found[: n - -(-percent * n // 100) + 1]


def _sketched(k: int, bands: int, rows: int, percent: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(bands, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            sizes, digests, keys, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, k)
                sizes.append(len(found))
                if not len(found):
                    digests.append(None)
                    keys.append(None)
                    bits.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sig = signature(found, bands * rows)
                last = np.zeros(256, np.uint8)
                last[: len(sig)] = sig & np.uint32(1)
                bits.append(np.packbits(last).view(np.int64))
                if percent is not None:
                    keys.append(prefix(found, percent).view(np.int64))
                    continue
                sig = sig.reshape(bands, rows)
                key = mixed(numbers + np.uint64(1))
                for j in range(rows):
                    key = mixed(key + sig[:, j])
                keys.append(key.view(np.int64))
            arrays = [batch.column(c) for c in ("node", "doc_id", "text_hash")] + [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "doc_id", "text_hash", "n_shingles", "digest", "bands", "bits"])

    return run


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sets of hashes reach the Jaccard similarity."""
    both = np.concatenate((p, q))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            linked = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                linked.append(similar(p, q, percent))
            keep = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node on an edge (a, b), by contraction: each node points to its smallest neighbour if
    that is smaller; pointers are followed to their ends by doubling; edges move to these ends, loops and repeats go,
    until no edge is left.  A chain of n nodes takes about log2(n) doublings, whatever its order."""
    spark = edges.sparkSession
    labels = None
    edges = stored(edges.select("a", "b"), f"{name}-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"), F.lit(True).alias("moved")), f"{name}-step")
        while True:
            ahead = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = stored(step.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), f"{name}-step")
            discard(step)
            step = jumped
            if step.where("moved").isEmpty():
                break
        to_a = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        to_b = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("ta <> tb")
        rest = stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{name}-edges")
        discard(edges)
        edges = rest
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            next_ = step.select(F.col("node").alias("component"), F.col("to").alias("next"))
            labels = stored(labels.join(next_, "component", "left").select("node", F.coalesce("next", "component").alias("component")), f"{name}-labels")
    return labels if labels is not None else spark.createDataFrame([], "node long, component long")


def _possible(percent: int):
    """Two sets this different in size cannot be similar enough."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", exact: bool = False) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_shingles, component_id (smallest id of its component), node (row
    number) and lead (the node that stands for the component).  ``exact`` finds every link by prefix filter."""
    bands, rows = banding(percent)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    numbered = source.withColumn("node", F.monotonically_increasing_id())
    sketch = stored(numbered.mapInArrow(_sketched(k, bands, rows, percent if exact else None), "node long, doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, bits array<long>"), "near-sketch")

    # Classes of equal sets.
    some = sketch.where("digest is not null")
    heads = stored(some.groupBy("digest").agg(F.min("node").alias("head")), "near-heads")
    member = some.join(heads, "digest").select("node", "doc_id", "text_hash", "n_shingles", "head", F.when(F.col("head") == F.col("node"), F.col("bands")).alias("bands"))
    empty = sketch.where("digest is null").select("node", "doc_id", "text_hash", "n_shingles", F.col("node").alias("head"), "bands")
    member = stored(member.unionByName(empty), "near-member")
    release(docs.sparkSession)

    # Buckets with company, and in each the member that has the most company over all its buckets.
    placed = member.where("bands is not null").select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    sizes = stored(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("company")).where("company > 1"), "near-sizes")
    shared = stored(placed.join(sizes, "bucket"), "near-buckets")
    degree = shared.groupBy("node").agg(F.sum("company").alias("degree"))
    ranked = stored(shared.join(degree, "node"), "near-ranked")
    best = stored(ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "n")).alias("best")), "near-best")
    first = ranked.join(best, "bucket").select(F.col("node").alias("x"), (-F.col("best.minus")).alias("y"), F.col("n").alias("na"), F.col("best.n").alias("nb"))
    first = first.where((F.col("x") != F.col("y")) & _possible(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = stored(first, "near-first")

    # Full sets of the candidates.  Node numbers hold only for the scan that gave them, so a second scan finds a node
    # by its doc_id and text.
    members = shared.select("node").distinct()
    wanted = sketch.join(members, "node").select("node", "text_hash", "digest", "doc_id")
    sets = stored(_candidate_sets(source, wanted, k), "near-sets")
    release(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda side: sets.select(F.col("node").alias(side), F.col("members").alias(f"members_{side}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "members_a", "members_b").mapInArrow(_verified(percent), "a long, b long")

    links = stored(verified(first), "near-links")
    full = connected(links, "near-first-components")

    # Buckets that still hold several components; the families that these components form.
    at = shared.where("company > 2").join(full, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    apart = stored(at.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket", "low"), "near-apart")
    at = at.join(apart, "bucket")
    family = connected(at.where("low < component").select(F.col("low").alias("a"), F.col("component").alias("b")).distinct(), "near-families")
    open_ = at.select("node", "n", "component").distinct().join(family.select(F.col("node").alias("component"), F.col("component").alias("family")), "component")
    open_ = stored(open_, "near-open")
    found = _blocks(open_).join(sketch.select("node", "bits"), "node").join(sets, "node")
    more = found.groupBy("family", "low", "high").applyInArrow(_compared(percent, bands * rows if exact else most_bits(percent, bands * rows)), "a long, b long")
    more = stored(more, "near-more-links")
    if not more.isEmpty():
        full = connected(links.unionByName(more), "near-components")

    whole = member.drop("bands").join(full.select(F.col("node").alias("head"), "component"), "head", "left").withColumn("component", F.coalesce("component", "head"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node"))).node.alias("low"), F.min("node").alias("any"))
    whole = whole.join(stored(least, "near-least"), "component")
    return whole.select("doc_id", "text_hash", "node", "n_shingles", "component_id", F.coalesce("low", "any").alias("lead"))


def _blocks(open_: DataFrame) -> DataFrame:
    """Each member in its block of its family, once for every pair (low, high) of blocks that this one is in.

    Components above a block's size have blocks of their own (members by hash), numbered from ``first``; smaller ones
    share the family's first ``shared`` blocks (whole components by hash), which also meet themselves."""
    full = lambda n, rows: F.ceil(F.greatest(F.sum(n) * 8 / BLOCK, F.sum(rows) / BLOCK_ROWS)).cast("int")
    size = open_.groupBy("family", "component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    large = (F.col("n") * 8 >= BLOCK) | (F.col("rows") >= BLOCK_ROWS)
    shared = size.where(~large).groupBy("family").agg(full("n", "rows").alias("shared"))
    own = size.where(large).groupBy("family", "component").agg(full("n", "rows").alias("own"))
    own = own.withColumn("end", F.sum("own").over(W.partitionBy("family").orderBy("component")))  # a row per block's worth of members
    parts = own.groupBy("family").agg(F.max("end").alias("most"))
    dealt = open_.join(own, ["family", "component"], "left").join(shared, "family", "left").join(parts, "family", "left")
    dealt = dealt.withColumns({"shared": F.coalesce("shared", F.lit(0)), "most": F.coalesce("most", F.lit(0))})
    first = F.col("shared") + F.col("end") - F.col("own")
    part = F.when(F.col("own").isNotNull(), first + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("component"), F.col("shared")))
    dealt = dealt.withColumns({"part": part.cast("int"), "first": first, "parts": (F.col("shared") + F.col("most")).cast("int")})
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = other.where(F.col("own").isNull() | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("own")))
    return other.select("family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "n", "component")


def _compared(percent: int, limit: int):
    """Links between the members of two blocks (or within one) that are in different components and whose signatures do
    not rule them out.  Components that a link joins are one for the pairs that follow."""

    def run(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        node, part, n = (found.column(c).to_numpy() for c in ("node", "part", "n"))
        names, component = np.unique(found.column("component").to_numpy(), return_inverse=True)
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in found.column("members")]
        bits = np.ascontiguousarray(found.column("bits").combine_chunks().flatten().to_numpy().reshape(len(node), -1))
        signs = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        low = int(found.column("low")[0].as_py())
        within = low == int(found.column("high")[0].as_py())
        left = np.flatnonzero(part == low)
        right = left if within else np.flatnonzero(part != low)
        if not len(right):  # the other block has no member
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root, a, b = list(range(len(names))), [], []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for start in range(0, len(left), 256):
            some = left[start : start + 256]
            differ = (signs.shape[1] - signs[some] @ signs[right].T) / 2
            p, q = n[some][:, None], n[right]
            good = (differ <= limit) & (component[some][:, None] != component[right]) & (100 * np.minimum(p, q) >= percent * np.maximum(p, q))
            if within:
                good &= some[:, None] < right
            for i, j in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
                x, y = some[i], right[j]
                cx, cy = top(component[x]), top(component[y])
                if cx != cy and similar(members[x], members[y], percent):
                    root[cx] = cy
                    a.append(node[x])
                    b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _candidate_sets(source: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, members) of the wanted nodes: their doc_id and text hash find the texts, the digest of the set confirms
    them.  Only one row per node is left, whatever copies a table holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, digest, text in zip(*(batch.column(c).to_pylist() for c in ("node", "digest", "text")), strict=True):
                found = shingle_set(text, k).tobytes()
                if xxhash.xxh3_128_digest(found) == digest:
                    nodes.append(node)
                    sets.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "members"])

    found = source.join(wanted, source["doc_id"].eqNullSafe(wanted["doc_id"]) & (source["text_hash"] == wanted["text_hash"])).select("node", "digest", "text").mapInArrow(run, "node long, members binary")
    return found.dropDuplicates(["node"])


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingles and a similarity of 0.85 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
