"""Best-fit packing of token sequences, certified by lower bounds.

Documents become pieces of at most ``CAPACITY`` tokens.  Partitions of about ``PART`` pieces are packed by best fit
decreasing.  Dual feasible functions (sizes to shares that no full sequence can exceed) bound from below how many
sequences a partition needs; where best fit meets the bound, the partition is done.  Partitions with a gap hand their
least filled sequences to an exchange with their neighbours (certified ones their emptiest), where best fit runs again on
all that was handed over; the result counts only if it needs fewer sequences.  Each round widens the neighbourhood.  Packing sees lengths and row
numbers only, never tokens.

Defined results: null and empty texts are one token (the end); repeated rows are packed each; a null doc_id is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import stored, table
from panelmark.llm.tokens import CHUNK, LONG, MEMO, in_steps, loaded, vocabulary

CAPACITY, END, PART, NEIGHBOURS, ROUNDS = 2048, 0, 20_000, 16, 2

#: Characters of a text that are looked at in one go.
SPAN = 1_000_000
#: Pre-tokens of lower-case Latin-1 text under the pattern below: among these 256 characters, letters, numbers and white
#: space of Unicode are the ones listed.
_LATIN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: The settings of the vocabulary file that the pattern above stands for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: The characters that stand for bytes in byte-level vocabularies: printable ones themselves, the others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _PreTokens(dict):
    """Ids of pre-tokens of up to ``LONG`` characters, each given to the model once; emptied when full, so its memory is
    bounded."""

    def __init__(self, model):  # noqa: ANN001
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> bytes:
        shown = "".join(_BYTES[b] for b in part.encode())
        ids = _packed_ids([t.id for t in self.model.tokenize(shown)])
        if len(part) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[part] = ids
        return ids


def _spans(text: str) -> Iterator[str]:
    """The text in pieces of about ``SPAN`` characters, cut before a blank, which no pre-token holds."""
    start = 0
    while len(text) - start > SPAN and (end := text.find(" ", start + SPAN)) >= 0:
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of texts as unsigned 32-bit integers, little end first.

    Latin-1 text in a vocabulary of the settings above is composed (NFC) already, and its pre-tokens are known without
    the tokenizer; the model sees each distinct one once.  Other texts are cut where no pre-token can cross, as for
    counts, and their new pieces go through the whole tokenizer.  So do texts that name a special token."""

    def __init__(self, path: str):
        self.tokenizer = loaded(path)
        self.parts, self.chunks, self.cut = _PreTokens(self.tokenizer.model), {}, re.compile(CHUNK)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = self._known(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _known(settings: dict) -> bool:
        normal = [n["type"] for n in (settings["normalizer"] or {}).get("normalizers", [])]
        split = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
        return normal == _NORMALIZERS and [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["pattern"].get("Regex") == _PATTERN and not split[1]["add_prefix_space"] and not split[1]["use_regex"]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole([text])[0]
        of = self._of_latin if self.known and _latin(text) else self._of_chunks
        return b"".join(map(of, _spans(text)))

    def _of_latin(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _LATIN.findall(text.lower())))

    def _of_chunks(self, text: str) -> bytes:
        found = self.cut.findall(text)
        missing = [c for c in set(found) if c not in self.chunks]
        if len(self.chunks) + len(missing) > MEMO:
            self.chunks.clear()
            missing = list(set(found))
        self.chunks.update(zip(missing, self._whole(missing), strict=True))
        out = b"".join(map(self.chunks.__getitem__, found))
        for c in missing:
            if len(c) > LONG:
                del self.chunks[c]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed_ids(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoded(path: str, text: str) -> bytes:
    """Ids of a text; a worker keeps one encoder for each vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path](text)


def _pieces(path: str, capacity: int):
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id")
            for part in in_steps(texts, len, 1_000_000):
                owner, piece, start, length, crc = [], [], [], [], []
                for i in range(part.start, part.stop):
                    ids = encoded(path, texts[i]) + end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        owner.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                arrays = [doc_ids.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, fill of each bin); the fullest bin that fits, found by a bit mask of rests."""
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            rest = size + ((fits & -fits).bit_length() - 1)
            b = open_[rest].pop()
            if not open_[rest]:
                mask &= ~(1 << rest)
        else:
            b, rest = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if rest > size:
            if not open_.get(rest - size):
                mask |= 1 << (rest - size)
            open_.setdefault(rest - size, []).append(b)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best bound of two families of dual feasible functions."""
    return bound_of(np.bincount(sizes, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length."""
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for small in range(1, capacity // 2 + 1, 16):  # large ones count whole, those below ``small`` not at all
        share = np.where(x > capacity - small, capacity, np.where(x < small, 0, x))
        best = max(best, -(-int((count * share).sum()) // capacity))
    for k in range(1, 21):  # rounded to multiples of 1 / k
        whole = (x * (k + 1)) % capacity == 0
        share = np.where(whole, x * k, (x * (k + 1)) // capacity * capacity)
        best = max(best, -(-int((count * share).sum()) // (capacity * k)))
    return best


def _handed_over(fill: np.ndarray, gap: int, capacity: int) -> np.ndarray:
    """Bins to give away: the emptiest, with slack for the bins to save and as much again.  A certified partition gives
    its emptiest one, which may fill up with those of others."""
    out = np.zeros(len(fill), bool)
    order = np.argsort(fill, kind="stable")
    order = order[fill[order] < capacity]
    slack = np.cumsum(capacity - fill[order])
    out[order[: int(np.searchsorted(slack, 2 * gap * capacity)) + 1]] = True
    return out


PACKED = "row long, length long, part long, bin long, offset long, open boolean"


def _packed(capacity: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Pack a partition, or repack what its neighbours handed over if that saves sequences."""
        frame = frame.sort_values(["row"], kind="stable").reset_index(drop=True)
        sizes = frame["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        if "bin" in frame:
            code, old = np.unique(np.c_[frame["part"].to_numpy(), frame["bin"].to_numpy()], axis=0, return_inverse=True)
            if len(code) <= len(fill):
                bins, offsets, fill = old.ravel(), frame["offset"].to_numpy(np.int64), np.bincount(old.ravel(), weights=sizes).astype(np.int64)
        return pd.DataFrame({"row": frame["row"], "length": sizes, "part": frame["group"].astype("int64"), "bin": bins, "offset": offsets, "open": np.zeros(len(bins), bool) if last else _handed_over(fill, len(fill) - lower_bound(sizes, capacity), capacity)[bins]})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """(row, sequence_id, offset) of pieces (row, length)."""
    parts = max(1, -(-pieces.count() // part_rows))
    rows = pieces.select("row", "length").withColumn("group", F.pmod(F.xxhash64("row"), F.lit(parts)))
    result = None
    for turn in range(rounds + 1):
        packed = stored(rows.groupBy("group").applyInPandas(_packed(capacity, turn == rounds), PACKED), f"packing-{turn}")
        done = packed.where("not open").select("row", (F.lit(turn) * F.lit(1 << 58) + F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
        result = done if result is None else result.unionByName(done)
        rows = packed.where("open").withColumn("group", F.floor(F.col("part") / NEIGHBOURS))
    return result


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences of a packing, lower bound on those of any packing of the same pieces)."""
    lengths = packed.groupBy("length").count().collect()  # ``capacity`` rows at most
    count = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        count[r["length"]] = r["count"]
    return packed.select("sequence_id").distinct().count(), bound_of(count, capacity)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = source.mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    return pieces.join(pack(pieces, capacity), "row").drop("row")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
