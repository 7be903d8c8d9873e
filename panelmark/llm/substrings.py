"""Removal of long passages that an earlier document already holds, by seed and extend.

A window is ``length`` consecutive words.  A word goes if a window that covers it also starts in a document with a
smaller id.  Three steps, none of which looks at pairs of documents:

1. Seeds.  Winnowing keeps, of every run of seed-length grams that a window spans, the one with the least hash.  Equal
   windows keep the same seed, so a window that occurs in two texts has a seed that does.  Seeds are joined on their
   hash; only those of two or more texts go on.
2. Extension.  A text with shared seeds extends each both ways: to every window that chose this seed, up to a window's
   length left and right.  Windows meet on 96 bits of hashes of their words, all copies at once and not pair by pair
   (pairs would grow with the square of a common passage's copies).  Of equal windows the text with the smallest id
   comes first; the others' starts are repeats.
3. Repeats.  The starts of a text merge to maximal spans, which are cut out: a longer repeat is one whose windows follow
   each other.

Equal texts are one text with the smallest id of its rows in steps 1 and 2; their other rows lose every window.  A batch
passes on one row for a seed or window, however many of its texts hold it, so common passages do not pile up.

Defined results: null and empty texts have no words and stay as they are; texts shorter than a window lose nothing;
rows that repeat an id are not earlier than each other; a null doc_id is later than every other id; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmark.llm.common import mixed, release, stored, table, unused
from panelmark.llm.tokens import in_steps

SEED = 5
#: Starts that leave a task as one batch of rows.
AT_ONCE = 100_000
LAST = (1 << 63) - 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def text_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, without an object for each: a polynomial over random numbers for the
    bytes, from differences of running sums, mixed with the length.  Words of more than ``LONG`` bytes are hashed one by
    one.  Texts are handled about ``TOGETHER`` bytes at once, a longer one alone."""
    out: list[np.ndarray] = []
    for part in in_steps(texts, len, TOGETHER):
        some = texts[part]
        raw = b"\n".join(some)
        starts, hashes = _hashes(raw)
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in some]))
        out += np.split(hashes, cuts[:-1])
    return out


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word."""
    data = np.frombuffer(raw, np.uint8)
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    np.take(_SPACE, data, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + len(_POWERS), side="right")))
        begin, end = starts[at], ends[to - 1]
        if end - begin <= len(_POWERS):
            sums = np.zeros(end - begin + 1, np.uint64)
            values = _BYTES[data[begin:end]]
            values *= _POWERS[: end - begin]
            np.cumsum(values, out=sums[1:])
            own = starts[at:to] - begin
            out[at:to] = (sums[ends[at:to] - begin] - sums[own]) * _INVERSES[own]
        at = to
    lengths = ends - starts
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return starts, mixed(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _running(factor: int, n: int) -> np.ndarray:
    """1, factor, factor ** 2, ... in 64 bits."""
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, factor, np.uint64)), dtype=np.uint64)


TOGETHER, LONG, _FACTOR = 1 << 20, 1 << 16, 0xD1342543DE82EF95
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
_POWERS, _INVERSES = _running(_FACTOR, 1 << 17), _running(pow(_FACTOR, -1, 1 << 64), 1 << 17)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``, by minima of runs of powers of two."""
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def seeds(h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the seed that each window chooses, by window start; the same)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += h[j : j + len(grams)]
        grams ^= grams >> np.uint64(32)
    least = least_of(mixed(grams), length - k + 1)
    return least, least[:n]


def window_hashes(h: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that start at the given places, 64 and 32 bits: polynomials over well mixed word hashes,
    mixed again.  Among 1e13 windows no two different ones are expected to agree in both (6e-4 pairs)."""
    out, check = np.full(len(at), length, np.uint64), np.full(len(at), ~length & 0xFFFF, np.uint64)
    for j in range(length):
        word = h[at + j]
        out = out * np.uint64(0x9E3779B97F4A7C15) + word
        out ^= out >> np.uint64(32)
        check = check * np.uint64(0xD1342543DE82EF95) + (word ^ (word >> np.uint64(29)))
    return mixed(out), (mixed(check) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def squeezed(text: str | None) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress((text or "").encode())


def opened(value) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _grouped(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(owners, the bytes of each owner's values): one row for a text in place of one for each value."""
    if not len(owner):
        return owner, []
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    return owner[np.append(0, cuts)], [x.tobytes() for x in np.split(values, cuts)]


def _seeds_of(length: int, k: int):
    """(key, text_hash, packed): a seed once for a batch, with the text that holds it; no text if several of the batch
    do, for then it is shared already.  Those texts' shared seeds come packed, under keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = batch.column("text").to_pylist(), batch.column("text_hash").to_numpy(zero_copy_only=False)
            for part in in_steps(texts, lambda t: len(t or ""), 32_000_000):
                found = [np.unique(seeds(h, length, k)[0]) for h in text_hashes([(t or "").encode() for t in texts[part]])]
                owner = np.repeat(hashes[part].astype(np.int64), [len(x) for x in found])
                seed = np.concatenate(found) if found else np.zeros(0, np.uint64)
                order = np.lexsort((owner, seed))
                seed, owner = seed[order], owner[order]
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
                seed, owner = seed[new], owner[new]
                first = np.ones(len(seed), bool)
                first[1:] = seed[1:] != seed[:-1]
                count = np.diff(np.append(np.flatnonzero(first), len(seed)))
                several = np.repeat(count > 1, count)
                yield _batch(seed[first], pa.array(owner[first], pa.int64(), mask=several[first]), pa.nulls(int(first.sum()), pa.binary()))
                owners, packed = _grouped(owner[several], seed[several])
                yield _batch(mixed(owners.view(np.uint64)), pa.array(owners, pa.int64()), pa.array(packed, pa.binary()))

    def _batch(key, owner, packed):
        return pa.RecordBatch.from_arrays([_signed(key), owner, packed], ["key", "text_hash", "packed"])

    return run


def _shared_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of the key: keep the seeds with another row or without a text, packed by text.  Of a batch
    the last row waits for the next."""
    held: pa.Table | None = None
    waits_shared = False

    def rows(owner, seeds_):
        owners, packed = _grouped(owner, seeds_)
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(packed, pa.binary())], ["text_hash", "seeds"])

    for batch in batches:
        ready = batch.filter(batch.column("packed").is_valid())
        yield pa.RecordBatch.from_arrays([ready.column("text_hash"), ready.column("packed")], ["text_hash", "seeds"])
        single = pa.Table.from_batches([batch.filter(batch.column("packed").is_null())]).select(["key", "text_hash"])
        table_ = single if held is None else pa.concat_tables([held, single])
        if not table_.num_rows:
            continue
        seed, marked = table_.column("key").to_numpy(), table_.column("text_hash").is_null().to_numpy()
        owner = table_.column("text_hash").fill_null(0).to_numpy()
        shared = marked.copy()
        same = seed[1:] == seed[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= waits_shared
        keep = shared & ~marked
        keep[-1] = False
        yield rows(owner[keep], seed[keep])
        held, waits_shared = table_.slice(table_.num_rows - 1), bool(shared[-1])
    if held is not None and waits_shared and held.column("text_hash")[0].is_valid:
        yield rows(held.column("text_hash").to_numpy(), held.column("key").to_numpy())


def _windows_of(length: int, k: int):
    """Windows over shared seeds: (key, first, text_hash, place, more); a place is the window's check and its start.  Of each window of a batch one row goes on, that
    of the text with the smallest (first, text_hash); ``more`` are the text's other starts of the same window.  Starts
    of later texts are repeats already: they come packed in ``more``, with no start, under keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, firsts, hashes, shared = (batch.column(c) for c in ("packed", "first", "text_hash", "seeds"))
            sizes = [len(x.as_buffer()) for x in packed]
            for part in in_steps(sizes, lambda x: 3 * x, 16_000_000):
                windows, checks, first, owner, start = [], [], [], [], []
                hashed_texts = text_hashes([opened(packed[i].as_buffer()) for i in range(part.start, part.stop)])
                for i, h in zip(range(part.start, part.stop), hashed_texts, strict=True):
                    chosen = seeds(h, length, k)[0]
                    wanted = np.sort(np.frombuffer(b"".join(shared[i].as_py()), np.uint64))
                    place = np.minimum(np.searchsorted(wanted, chosen), len(wanted) - 1)
                    at = np.flatnonzero(wanted[place] == chosen)
                    hashed, check = window_hashes(h, length, at)
                    windows.append(hashed)
                    checks.append(check)
                    start.append(at.astype(np.int32))
                    first.append(np.full(len(at), firsts[i].as_py(), np.int64))
                    owner.append(np.full(len(at), hashes[i].as_py(), np.int64))
                w, c, f, o, s = (np.concatenate(x) for x in (windows, checks, first, owner, start))
                order = np.lexsort((s, o, f, c, w))
                w, c, f, o, s = w[order], c[order], f[order], o[order], s[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
                heads = np.flatnonzero(new)
                size = np.diff(np.append(heads, len(w)))
                late = f > np.repeat(f[heads], size)
                # One row for each window and text that goes on; the text's other starts of this window travel with it.
                own = ~late & (new | np.insert(o[1:] != o[:-1], 0, True))
                number = np.cumsum(own) - 1
                again = ~late & ~own
                more = [None] * int(own.sum())
                for n, x in zip(*_grouped(number[again], s[again]), strict=True):
                    more[n] = x
                yield _rows(w[own], f[own], o[own], pa.array((c[own].astype(np.int64) << 32) | s[own], pa.int64()), more)
                ids = {}
                for a, b in zip(o[late].tolist(), f[late].tolist(), strict=True):
                    ids[a] = b
                owners, starts = _grouped(o[late], s[late])
                yield _rows(mixed(owners.view(np.uint64)), np.array([ids[x] for x in owners.tolist()], np.int64), owners, pa.nulls(len(owners), pa.int64()), starts)

    def _rows(w, f, o, place, more):
        return pa.RecordBatch.from_arrays([_signed(w), pa.array(f, pa.int64()), pa.array(o, pa.int64()), place, pa.array(more, pa.binary())], ["key", "first", "text_hash", "place", "more"])

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (key, check, first): all starts but those of the window's smallest id are repeats, a row
    each, so that rows grow with the repeats alone."""
    window, head = None, 0

    def rows(owner, first, start) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(first), pa.array(start)], ["text_hash", "first", "start"])

    def unrolled(found: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Packed starts, about ``AT_ONCE`` at a time, however many a batch holds."""
        packs = [np.frombuffer(x.as_buffer(), np.int32) for x in found.column("more")]
        owner, first = (found.column(c).to_numpy() for c in ("text_hash", "first"))
        for part in in_steps(packs, len, AT_ONCE):
            times = [len(x) for x in packs[part]]
            yield rows(np.repeat(owner[part], times), np.repeat(first[part], times), np.concatenate(packs[part]))

    for batch in batches:
        yield from unrolled(batch.filter(batch.column("place").is_null()))
        batch = batch.filter(batch.column("place").is_valid())
        w, c, f = (batch.column(x).to_numpy() for x in ("key", "place", "first"))
        c = c >> 32
        if not len(w):
            continue
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
        new[0] = (w[0], c[0]) != window
        at = np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))
        heads = np.where(at >= 0, f[at], head)
        window, head = (w[-1], c[-1]), heads[-1]
        batch = batch.filter(pa.array(f > heads))
        yield rows(batch.column("text_hash").to_numpy(), batch.column("first").to_numpy(), (batch.column("place").to_numpy() & 0xFFFFFFFF).astype(np.int32))
        yield from unrolled(batch.filter(batch.column("more").is_valid()))


def spans(starts, length: int) -> list[tuple[int, int]]:
    """Maximal spans [begin, end) of words that windows at these starts cover."""
    if starts is None or not len(starts):
        return []
    s = np.unique(np.asarray(starts))
    cut = np.flatnonzero(s[1:] > s[:-1] + length)
    return list(zip(s[np.append(0, cut + 1)].tolist(), (s[np.append(cut, len(s) - 1)] + length).tolist(), strict=True))


def identity(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit("again"), t)


def repeat_starts(docs: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id", seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts: text_hash, other_hash, first; repeats: text_hash, first, starts): the distinct texts with the smallest
    id of their rows, and the starts of the windows of each that a text with a smaller id holds."""
    k = seed or max(1, min(length, SEED if length < 30 else length // 3))
    one, two = identity(F.col(text))
    keyed = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST)).cast("long").alias("id"), F.col(text).alias("text"), one.alias("text_hash"), two.alias("other_hash"))
    texts = stored(keyed.groupBy("text_hash", "other_hash").agg(F.min("id").alias("first")), "repeat-texts")
    found = keyed.select("text", "text_hash").mapInArrow(_seeds_of(length, k), "key long, text_hash long, packed binary")
    hits = found.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_seeds, "text_hash long, seeds binary")
    wanted = hits.groupBy("text_hash").agg(F.collect_list("seeds").alias("seeds"))
    wanted = stored(texts.join(wanted, "text_hash"), "repeat-wanted")
    release(docs.sparkSession)

    packed = keyed.select("id", "text_hash", "other_hash", squeeze("text").alias("packed"))
    on = ["text_hash", "other_hash"]
    chosen = packed.join(wanted, on).where("id = first").select("packed", "first", "text_hash", "seeds")
    windows = chosen.mapInArrow(_windows_of(length, k), "key long, first long, text_hash long, place long, more binary")
    starts = windows.repartition("key").sortWithinPartitions("key", F.shiftright("place", 32), "first").mapInArrow(_repeats, "text_hash long, first long, start int")
    repeats = stored(starts.groupBy("text_hash", "first").agg(F.collect_list("start").alias("starts")), "repeat-starts")
    release(docs.sparkSession)
    return texts, repeats


@F.pandas_udf(T.BinaryType())
def squeeze(texts: pd.Series) -> pd.Series:
    """Compressed text, for shuffles."""
    return texts.map(squeezed)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests, kept_texts = [], [], [], []
            for value, starts, copy, null in zip(batch.column("packed"), batch.column("starts"), batch.column("copy").to_pylist(), batch.column("null").to_pylist(), strict=True):
                raw = opened(value.as_buffer())
                found = raw.split()
                n = len(found)
                if copy:
                    out = [(0, n)] if n >= length else []
                else:
                    out = spans(starts.values.to_numpy() if starts.is_valid else None, length)
                kept, at = [], 0
                for begin, end in out:
                    kept += found[at:begin]
                    at = end
                kept += found[at:]
                total.append(n)
                removed.append(n - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                kept_texts.append(None if null else without(raw, out).decode() if out else raw.decode())
            arrays = [batch.column("row"), pa.array(kept_texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "kept", "repeat_words", "repeat_removed", "repeat_sha256"])

    return run


def without(raw: bytes, out: list[tuple[int, int]]) -> bytes:
    """The text without these words and the white space behind them; the rest keeps its own."""
    places = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    parts, at = [], 0
    for begin, end in out:
        parts.append(raw[at : places[begin]])
        at = places[end]
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, length: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the repeats cut out of their texts, and repeat_words, repeat_removed (words before, words cut) and
    repeat_sha256 (digest of the kept words, joined by one blank).  A column of such a name that ``docs`` has keeps it,
    and the new one gets underscores behind its name."""
    texts, repeats = repeat_starts(docs, length, text, doc_id)
    known = stored(texts.join(repeats, ["text_hash", "first"], "left").select("text_hash", "other_hash", "first", "starts"), "repeat-known")
    one, two = identity(F.col(text))
    rest = F.struct(F.lit(0).alias("_"), *(docs[c] for c in docs.columns if c != text)).alias("row")
    keyed = docs.select(rest, F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.col(text).isNull().alias("null"), one.alias("text_hash"), two.alias("other_hash"), squeeze(text).alias("packed"))
    joined = keyed.join(known, ["text_hash", "other_hash"]).select("row", "packed", "starts", (F.col("id") > F.col("first")).alias("copy"), "null")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, kept string, repeat_words long, repeat_removed long, repeat_sha256 string"
    cut = joined.mapInArrow(_cut(length), schema)
    return cut.select(*(F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns), *(F.col(c).alias(unused(docs, c)) for c in ("repeat_words", "repeat_removed", "repeat_sha256")))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that start in an earlier document are cut, over all documents."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=13)
    return cut.select("doc_id", F.col("repeat_words").alias("n_words"), F.col("repeat_removed").alias("n_removed"), F.col("repeat_sha256").alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT win, min(coalesce(doc_id, 9223372036854775807)) AS low FROM g GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, i + o AS p FROM (SELECT rid, i, unnest(range(0, 13)) AS o FROM g JOIN m USING (win) WHERE coalesce(doc_id, 9223372036854775807) > low)),
a AS (SELECT rid, doc_id, len(ws) AS n, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS word, unnest(range(1, greatest(len(ws), 1) + 1)) AS p FROM w)
SELECT any_value(doc_id) AS doc_id, any_value(n)::BIGINT AS n_words, count(c.p)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY a.p), '')) AS kept_sha256
FROM a LEFT JOIN c ON a.rid = c.rid AND a.p = c.p GROUP BY a.rid
"""
