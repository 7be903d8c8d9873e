"""Scoring texts with a context-tree-weighting model of bytes, beside a unigram base score.

Each byte is coded as eight binary decisions.  A decision's context tree has the bytes before as its depths, up to
``DEPTH``; every node keeps a Krichevsky-Trofimov estimate, and the weighted probability mixes all depths: a node mixes
its own estimate with its children's product, half and half.  Counts are all that training needs: the KT probability of
a node depends only on how many zeros and ones it saw.

Texts are dealt to blocks.  A block gives its distinct grams (context and coded byte) with their counts in training
texts, 0 for those that only held-out texts have: nodes without counts change no weight and predict 1/2, as contexts do
that training never saw.  Grams travel packed, by parts: a part holds all grams of some three-byte suffixes of the
context, and of one suffix there are 256^3 different ones at most at ``DEPTH`` 5, whatever the corpus.  A task adds up
the counts of a part, weights that piece of the tree bottom-up and mixes each gram's probabilities down to depth 3.
What is above depth 3 has 255 nodes for each two bytes at most (256^3 in all), so the driver weights it and broadcasts
it.  Each part's probabilities then meet the packed grams of the blocks again, one pack after the other, and return to
the blocks.  Words have no such bound: the base score takes the most frequent ``TOP`` words from a bounded broadcast and
joins the rest.

Texts are lower-cased in A-Z, start in a context of zero bytes and end with one.

Defined results: a null text is an empty text, which has one token and the code length of its end; a null doc_id counts
as an empty id; repeated rows are learnt from and scored each; without training texts every estimate is 1/2 and every
base term is log10(1); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import discard, mixed, release, stored, table, word_hashes
from panelmark.llm.tokens import in_steps

#: Bytes of context, 3 to 5: a gram then takes 48 bits at most.
DEPTH = 5
#: Characters that a task looks at in one go; characters and distinct grams at which it closes a block.
STEP, BLOCK, BLOCK_GRAMS = 2_000_000, 32_000_000, 4_000_000
#: Parts of the tree, and grams that are weighted in one go (whole parts, so one may exceed it).
PARTS, ROWS = 4096, 500_000
#: Words that go to the workers at most: hash and count, 16 bytes each.
TOP = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER)


def deep_grams(raw: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The context from the nearest byte to the farthest, then the coded byte, as one integer for every coded byte."""
    joined = np.frombuffer(b"".join(bytes(depth) + x + b"\0" for x in raw), np.uint8)
    n = len(joined) - depth
    keys = joined[depth:].astype(np.int64)
    for i in range(depth):
        keys |= joined[depth - 1 - i : depth - 1 - i + n].astype(np.int64) << (8 * (depth - i))
    keep = np.ones(n, bool)  # not what crosses from one text to the next
    ends = np.cumsum([len(x) + 1 + depth for x in raw])[:-1]
    for i in range(1, depth + 1):
        keep[ends - i] = False
    return keys[keep]


def runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.r_[np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]])


def added(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n


def counted_grams(raw: list[bytes], held: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams of training texts with their counts, and of held-out texts with 0."""
    keys = deep_grams(raw, depth)
    out = np.repeat(held, [len(x) + 1 for x in raw])
    pieces = []
    for own, learn in ((keys[~out], 1), (keys[out], 0)):
        own.sort()
        at = runs(own)
        pieces.append((own[at], np.diff(np.r_[at, len(own)]) * learn))
    return pieces


def part_of(keys: np.ndarray, depth: int) -> np.ndarray:
    return (mixed((keys >> 8 * (depth - 2)).astype(np.uint64)) % np.uint64(PARTS)).astype(np.int32)


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Keys in order with their values (of one 4-byte type, any number for each key)."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=0).tobytes() + values.tobytes())


def unpacked(blob, kind, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // (8 + 4 * width)
    return np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, kind, n * width, 8 * n)


def by_part(keys: np.ndarray, values: np.ndarray, depth: int) -> tuple[list[int], list[bytes]]:
    """(parts, packs) of keys in order and their values."""
    parts = part_of(keys, depth)
    order = np.argsort(parts, kind="stable")
    at = runs(parts[order])
    return parts[order][at].tolist(), [packed(keys[own], values[own]) for own in np.split(order, at[1:])] if len(keys) else []


CHUNK = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary())])


def chunk(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CHUNK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


LEARNT = "kind byte, block long, part int, key long, n long, blob binary"


def _learnt(depth: int):
    """What a task learns, by kind: packed grams of a block and part (0), word hashes with counts in training texts (1),
    the number of these texts (2), and a block's texts in chunks (3)."""

    def rows(kind: int, block: int, size: int, **columns) -> pa.RecordBatch:
        kinds = {"part": pa.int32(), "key": pa.int64(), "n": pa.int64(), "blob": pa.binary()}
        arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), pa.array(np.full(size, block, np.int64)), *arrays], ["kind", "block", *kinds])

    def closed(block: int, pieces) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        keys, n = added(pieces)
        parts, blobs = by_part(keys, n.astype(np.uint32), depth)
        if parts:
            yield rows(0, block, len(parts), part=parts, blob=blobs)

    def counted(found: Counter) -> Iterator[pa.RecordBatch]:
        keys, n = word_hashes(list(found)).view(np.int64), np.fromiter(found.values(), np.int64, len(found))
        for at in range(0, len(keys), 100_000):
            own = slice(at, at + 100_000)
            yield rows(1, 0, len(keys[own]), key=keys[own], n=n[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = block = TaskContext.get().partitionId() << 33
        texts, found, pieces, size = 0, Counter(), [], 0
        for batch in batches:
            all_ = batch.column("text").to_pylist()
            for part in in_steps(all_, lambda t: len(t or "") + 1, STEP):
                raw = [lowered(t) for t in all_[part]]
                own = batch.slice(part.start, len(raw))
                held = own.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                arrays = [pa.array(np.arange(row, row + len(raw))), own.column("doc_id"), own.column("held_out"), pa.array(raw, pa.binary())]
                yield rows(3, block, 1, blob=[chunk(pa.RecordBatch.from_arrays(arrays, schema=CHUNK))])
                row += len(raw)
                pieces = [added([*pieces, *counted_grams(raw, held, depth)])]
                texts += int((~held).sum())
                for x, o in zip(raw, held, strict=True):
                    if not o:
                        found.update(x.split())
                if len(found) > 500_000:
                    yield from counted(found)
                    found.clear()
                size += sum(map(len, raw))
                if size >= BLOCK or len(pieces[0][0]) >= BLOCK_GRAMS:
                    yield from closed(block, pieces)
                    block, pieces, size = block + 1, [], 0
        yield from closed(block, pieces)
        yield from counted(found)
        yield rows(2, 0, 1, n=[texts])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series after moving x beyond 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


_HALVES, _WHOLES = log_gamma(np.arange(1 << 16) + 0.5), log_gamma(np.arange(1 << 16) + 1.0)


def kt_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``kt`` of integers, small ones by tables."""
    total = zeros + ones
    low = np.minimum(zeros, 0xFFFF), np.minimum(ones, 0xFFFF), np.minimum(total, 0xFFFF)
    out = _HALVES[low[0]] + _HALVES[low[1]] - _WHOLES[low[2]] - np.log(np.pi)
    large = total > 0xFFFF
    out[large] = kt(zeros[large], ones[large])
    return out


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted ln probability, and the weight of a node's own estimate against its children's."""
    return np.log(0.5) + np.logaddexp(own, below), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def subtrees(grams: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weight the tree from ``depth`` up to depth 3 over all grams of some three-byte suffixes (distinct, in order).

    Gives each gram's probabilities of its eight bits, mixed from depth 3 on, and the nodes of depth 3: key (suffix and
    decision node), zeros, ones, weighted ln probability."""
    rows, count, to = grams, n, np.arange(len(grams))
    p, below, nodes = np.empty((8, len(grams))), [None] * 8, []
    for d in range(depth, 2, -1):
        if d < depth:  # drop the farthest byte
            up = ((rows >> 16) << 8) | (rows & 255)
            order = np.argsort(up, kind="stable")
            at = runs(up[order])
            back = np.empty(len(up), np.int64)
            back[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(up)]))
            rows, count, to = up[order][at], np.add.reduceat(count[order], at), back[to]
        for k in range(8):
            starts = runs(rows >> (8 - k))
            node = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
            bit = (rows >> (7 - k)) & 1
            total, ones = np.add.reduceat(count, starts), np.add.reduceat(count * bit, starts)
            ln, one = kt_counts(total - ones, ones), (ones + 0.5) / (total + 1)
            taken = np.where(bit == 1, one[node], 1 - one[node])
            if d == depth:
                p[k] = taken
            else:
                first, deeper = below[k]
                ln, share = weighted(ln, np.bincount(node[back[first]], weights=deeper, minlength=len(starts)))
                own = share[node]
                p[k] = (own * taken)[to] + (1 - own)[to] * p[k]
            below[k] = starts, ln
            if d == 3:
                head = rows[starts]
                nodes.append((head >> 8 << 8 | 1 << k | (head & 255) >> (8 - k), total - ones, ones, ln))
    return p, [np.concatenate(x) for x in zip(*nodes, strict=True)]


WEIGHED = "part int, blob binary, key long, zeros long, ones long, ln double"


def _weighed(depth: int):
    """Packs in order of their parts to the probabilities of each part's grams, packed, and to the nodes of depth 3 (rows
    with ``ln``)."""
    names = [x.split()[0] for x in WEIGHED.split(", ")]

    def done(pieces) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        keys, n = added(pieces)
        p, nodes = subtrees(keys, n, depth)
        parts, blobs = by_part(keys, p.T.astype(np.float32), depth)
        nothing = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary()), *nothing], names)
        for i in range(0, len(nodes[0]), 100_000):
            key, zeros, ones, ln = (pa.array(x[i : i + 100_000]) for x in nodes)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary()), key, zeros, ones, ln], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, size = None, [], 0
        for batch in batches:
            for own, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                if size >= ROWS:
                    if own != part:
                        yield from done(pieces)
                        pieces, size = [], 0
                    elif size >= 4 * ROWS and len(pieces) > 1:  # one part of many blocks
                        pieces = [added(pieces)]
                        size = len(pieces[0][0])
                part = own
                keys, n = unpacked(blob.as_buffer(), np.uint32)
                pieces.append((keys, n.astype(np.int64)))
                size += len(keys)
        if pieces:
            yield from done(pieces)

    return run


def crown(nodes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b) of the decision nodes after two bytes: the probability of a one is a + b * what depth 3 gives."""
    key, zeros, ones, below = (nodes.column(x).to_numpy() for x in ("key", "zeros", "ones", "ln"))
    order = np.argsort(key)
    key, zeros, ones, below = key[order], zeros[order], ones[order], below[order]
    levels, to = [], np.arange(len(key))
    for d in (2, 1, 0):
        ln, share = weighted(kt_counts(zeros, ones), below)
        one = (ones + 0.5) / (zeros + ones + 1)
        levels.append((share[to], one[to]))
        if d:
            keys, back = np.unique(((key if d == 2 else keys) >> 16 << 8) | ((key if d == 2 else keys) & 255), return_inverse=True)
            zeros, ones = (np.bincount(back, weights=x, minlength=len(keys)).astype(np.int64) for x in (zeros, ones))
            below, to = np.bincount(back, weights=ln, minlength=len(keys)), back[to]
    a, b = np.zeros(len(key)), np.ones(len(key))
    for share, one in levels:  # from depth 2 up
        a, b = share * one + (1 - share) * a, (1 - share) * b
    return key, a, b


def _dealt(top, depth: int):  # noqa: ANN001
    """Rows in order of (part, kind), a part's probabilities before its packs: the log10 probabilities of each pack."""

    def logs_of(blob) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        keys, a, b = top.value
        g, p = unpacked(blob, np.float32, 8)
        p = p.reshape(-1, 8).astype(float)
        log, x = np.zeros(len(g)), g & 255
        for k in range(8):
            at = np.searchsorted(keys, (g >> 8 * (depth - 1) << 8) | 1 << k | x >> (8 - k))
            own = np.where((x >> (7 - k)) & 1 == 1, a[at], 1 - b[at] - a[at])
            log += np.log10(own + b[at] * p[:, k])
        return g, log.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = logs = None
        for batch in batches:
            blocks, blobs = [], []
            for kind, block, blob in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                if kind < 0:
                    grams, logs = logs_of(blob.as_buffer())
                    continue
                keys, _ = unpacked(blob.as_buffer(), np.uint32)
                blocks.append(block)
                blobs.append(packed(keys, logs[np.searchsorted(grams, keys)]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], ["block", "blob"])

    return run


def looked_up(own: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Value of each gram.  65,536 at a time are sorted together with their places (48 and 16 bits of one integer), so
    that the search walks through the table."""
    out = np.empty(len(own))
    for at in range(0, len(own), 1 << 16):
        some = own[at : at + (1 << 16)].astype(np.uint64) << np.uint64(16)
        some |= np.arange(len(some), dtype=np.uint64)
        some.sort()
        want = (some >> np.uint64(16)).astype(np.int64)
        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        if not np.array_equal(keys[place], want):
            raise ValueError("a block and its grams differ")
        out[at + (some & np.uint64(0xFFFF)).astype(np.int64)] = logs[place]
    return out


SCORED = "row long, doc_id long, held_out boolean, score double, n_coded long, words long, known long, logs double, rare array<long>, times array<int>"


def _scored(top, depth: int):  # noqa: ANN001
    names = [x.split()[0] for x in SCORED.split(", ")]

    def scored(own: pa.RecordBatch, grams: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        keys, logs = top.value
        raw = own.column("text").to_pylist()
        starts = np.cumsum([0] + [len(x) + 1 for x in raw])[:-1]
        score = np.add.reduceat(looked_up(deep_grams(raw, depth), grams, values), starts)
        tokens, known, base, rare, times = [], [], [], [], []
        for x in raw:
            h, n = np.unique(word_hashes(x.split()).view(np.int64), return_counts=True)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            tokens.append(int(n.sum()))
            known.append(int(n[hit].sum()))
            base.append(float((n[hit] * logs[at[hit]]).sum()) if hit.any() else 0.0)
            rare.append(h[~hit])
            times.append(n[~hit].astype(np.int32))
        arrays = [own.column("row"), own.column("doc_id"), own.column("held_out"), pa.array(score), pa.array([len(x) + 1 for x in raw], pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(chunks: pa.Table, packs: pa.Table) -> pa.Table:
        pieces = [unpacked(x.as_buffer(), np.float32) for x in packs.column("blob")]
        grams, values = (np.concatenate(x) for x in zip(*pieces, strict=True))
        del pieces
        order = np.argsort(grams)
        grams, values = grams[order], values[order]
        done = [scored(own, grams, values) for blob in chunks.column("blob") for own in pa.ipc.open_stream(blob.as_buffer())]
        return pa.Table.from_batches(done)

    return run


def frequent(counts: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted word hashes, log10(count + 1), least count) of the words above a count that at most ``top`` words reach."""
    capped = counts.groupBy(F.least("n", F.lit(4096)).alias("n")).count().collect()  # 4096 rows at most
    total, least = 0, 1 << 62
    for row in sorted(capped, key=lambda r: -r[0]):
        total += row[1]
        if total > top:
            break
        least = row[0]
    got = counts.where(F.col("n") >= least).select("key", "n").toArrow()
    keys, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.log10(n[order] + 1.0), least


def score_texts(docs: DataFrame, training, text: str = "text", doc_id: str = "doc_id", top: int = TOP, depth: int = DEPTH) -> DataFrame:  # noqa: ANN001
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``training`` is a condition on ``docs``; the model learns from the rows where it is true and scores all."""
    if not 3 <= depth <= 5:
        raise ValueError("depth is 3 to 5")
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (~training).alias("held_out"))
    learnt = stored(source.mapInArrow(_learnt(depth), LEARNT), "lm-learnt")
    packs = learnt.where("kind = 0").select("kind", "part", "block", "blob")
    weighed = stored(packs.select("part", "blob").repartition("part").sortWithinPartitions("part").mapInArrow(_weighed(depth), WEIGHED), "lm-weighed")
    release(spark)
    node = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    nodes = weighed.where("ln is not null").groupBy(node.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("ln").alias("ln")).toArrow()  # 256^3 rows at most
    counts = stored(learnt.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    texts = learnt.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    words, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    train_tokens, distinct = (total or 0) + texts, words + (texts > 0)
    model = spark.sparkContext.broadcast(crown(nodes))
    keys, logs, least = frequent(counts, top)
    heads = weighed.where("ln is null").select(F.lit(-1).cast("byte").alias("kind"), "part", F.lit(None).cast("long").alias("block"), "blob")
    dealt = heads.unionByName(packs).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_dealt(model, depth), "block long, blob binary")
    chunks = learnt.where("kind = 3").select("block", "blob")
    scored = chunks.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(_scored(spark.sparkContext.broadcast((keys, logs)), depth), SCORED)
    scored = stored(scored, "lm-scored")
    discard(learnt, weighed)
    release(spark)
    places = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("key"), F.col("p.times").alias("times"))
    seldom = counts.where(F.col("n") < least).withColumnRenamed("n", "count")
    rest = places.join(seldom, "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("rest"), F.sum("times").alias("found"))
    joined = scored.drop("rare", "times").join(rest, "row", "left")
    floor = float(np.log10(train_tokens + distinct + 1.0))
    n_tokens = F.col("words") + 1
    base = F.col("logs") + F.coalesce("rest", F.lit(0.0)) + F.lit(float(np.log10(texts + 1.0))) - n_tokens * F.lit(floor)
    known = F.col("known") + F.coalesce("found", F.lit(0)) + F.lit(int(texts > 0))
    bits = -F.col("score") / F.lit(float(np.log10(2.0))) / F.col("n_coded")
    return joined.select("doc_id", "held_out", n_tokens.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id leaves no 2 after division by 7."""
    docs = table(spark, sf_dir, "documents")
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return score_texts(docs, training)
