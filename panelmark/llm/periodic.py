"""Periodic runs of words by Crochemore's partition refinement, and texts with their repetitions collapsed.

A run is a stretch of words with a smallest period q, at least two periods long, that no neighbouring word extends.
Positions of equal factors form classes, first by word, then by ever longer factors.  A class splits where the positions
behind its members lie in different classes.  Of the parts of a split class the largest one need not be looked at again
(smaller half), so a position is moved O(log n) times.  A member whose next member of the class lies exactly one factor
length on starts a square; squares of one period that start at successive words are a run.

All texts of a step are refined together, one numpy pass per factor length, and a pass costs what it moves.  Each class
keeps its members in one stretch of an array and in a list by position.  A member's distance to the next one is checked
when it changes: it was a square if the factor length passed it meanwhile.  Factors that would go beyond their text's end
are neither counted nor split off: they come behind all whole ones, so they stand between no member and its square.
Lengths over half a text are not refined.

Words are numbered by a dictionary of each text, so equality is that of the words, never of hashes.  A text is handled
whole by one task, a step holds texts of about ``STEP`` characters (or one longer text), about 100 bytes a word.

Defined results: a null text has no runs and stays null; an empty one and one without words have none and collapse to an
empty text; repeated rows are judged alike; an empty table gives an empty result; other columns pass through untouched,
and if one has the name of a new column, the new one gets underscores behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import let, table, unused, words
from panelmark.llm.tokens import in_steps

#: Words of the shortest run.
SHORTEST = 12
STEP = 4_000_000
#: So many positions of different classes are split off one by one; a pass over arrays costs more.
FEW = 16


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin there and have so many numbers."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Partition:
    """Classes of positions with equal factors, over texts put end to end.

    ``word``: numbers of the words, never shared between texts.  ``ends``: end of each text."""

    def __init__(self, word: np.ndarray, ends: np.ndarray):
        n = len(word)
        lengths = np.diff(ends, prepend=0)
        self.length, self.first = 1, np.zeros(n, bool)
        self.first[(ends - lengths)[lengths > 0]] = True
        self.end = np.repeat(ends, lengths)
        # A position is refined as long as its factor lies in its text, and fits there twice.
        self.limit = np.minimum(self.end - np.arange(n), np.repeat(lengths // 2, lengths)).astype(np.int32)
        self.of = word.astype(np.int32)
        self.classes = int(word.max()) + 1 if n else 0
        self.size, self.begin = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        self.size[: self.classes] = np.bincount(word, minlength=self.classes)
        self.begin[: self.classes] = np.cumsum(self.size[: self.classes]) - self.size[: self.classes]
        self.whole = self.size.copy()  # members whose factors lie in their texts
        self.last = ends[lengths > 1]
        self.members = np.argsort(word, kind="stable").astype(np.int32)
        self.place = np.empty(n, np.int32)
        self.place[self.members] = np.arange(n, dtype=np.int32)
        self.next, self.before = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.since, self.moving = np.ones(n, np.int32), np.zeros(n, bool)
        self._chain(self.members, self.of[self.members])
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        # The first split is that of each whole text into its words: all classes but a text's largest are small.
        text = np.repeat(np.arange(len(ends)), lengths)
        owner = np.zeros(self.classes, np.int64)
        owner[self.of] = text
        by_size = np.lexsort((-self.size[: self.classes], owner))
        largest = np.ones(self.classes, bool)
        largest[1:] = owner[by_size[1:]] != owner[by_size[:-1]]
        small = np.ones(self.classes, bool)
        small[by_size[largest]] = False
        self.small = np.flatnonzero(small[self.of])

    def _chain(self, at: np.ndarray, group: np.ndarray) -> None:
        """Lists of the positions, which come by group and in order."""
        self.next[at], self.before[at] = -1, -1
        same = group[1:] == group[:-1]
        self.next[at[:-1][same]] = at[1:][same]
        self.before[at[1:][same]] = at[:-1][same]

    def _note(self, at: np.ndarray, reached: int | None) -> None:
        """Squares among the distances of these positions, which end at the factor length reached (None: never)."""
        at = at[self.next[at] >= 0]
        gap = self.next[at] - at
        ok = (self.since[at] <= gap) & (at + 2 * gap <= self.end[at])
        if reached is not None:
            ok &= gap <= reached
        if ok.any():
            self.squares.append((at[ok], gap[ok]))

    def refine(self) -> None:
        """From factors of ``length`` words to one more."""
        over = self.of[self.last - self.length]
        np.subtract.at(self.whole, over, 1)
        splitter = self.small[~self.first[self.small]]
        at = splitter - 1
        use = (self.limit[at] > self.length) & (self.whole[self.of[at]] > 1)
        at, behind = at[use], self.of[splitter[use]]
        self.small = at[:0]
        if len(at) > FEW or len(set(self.of[at].tolist())) < len(at):
            self._split(at, behind)
        elif len(at):
            for i in at.tolist():
                self._single(i)
            self.small = at
        self.length += 1
        self.last = self.last[self.limit[self.last - self.length] >= self.length]

    def _single(self, i: int) -> None:
        """Split off one position from a class that has other whole members: ``_split`` without arrays."""
        old, new, length = int(self.of[i]), self.classes, self.length
        left, right, since = int(self.before[i]), int(self.next[i]), self.since
        for a, b in ((i, right), (left, i)):
            if a >= 0 and b >= 0 and since[a] <= b - a <= length and b - a + b <= self.end[a]:
                self.squares.append((np.array([a]), np.array([b - a])))
        if left >= 0:
            self.next[left] = right
            since[left] = length + 1
        if right >= 0:
            self.before[right] = left
        self.next[i] = self.before[i] = -1
        since[i] = length + 1
        self.size[old] -= 1
        self.whole[old] -= 1
        tail, place = int(self.begin[old] + self.size[old]), int(self.place[i])
        other = int(self.members[tail])
        self.members[place], self.place[other] = other, place
        self.members[tail], self.place[i] = i, tail
        self.size[new] = self.whole[new] = 1
        self.begin[new], self.of[i] = tail, new
        self.classes += 1

    def _split(self, at: np.ndarray, behind: np.ndarray) -> None:
        own = self.of[at]
        key = own.astype(np.int64) * (len(self.of) + 1) + behind
        order = np.argsort(key, kind="stable")
        at, own, key = at[order], own[order], key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count, of = np.diff(np.append(new, len(at))), own[new]
        head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(of))))
        rest = self.whole[of[head]] - np.add.reduceat(count, head)
        # The largest group of each class; it keeps the class's number if no other member is left.
        by_size = np.lexsort((-count, which))
        top = by_size[head]
        most = count[top]
        exempt = np.zeros(len(count), bool)
        exempt[top[most > rest]] = True
        stays = np.zeros(len(count), bool)
        stays[top[rest == 0]] = True
        moved = np.repeat(~stays, count)
        if not moved.any():
            return
        small_rest = of[head][(rest > 0) & (most > rest)]
        at, own, count, of, exempt = at[moved], own[moved], count[~stays], of[~stays], exempt[~stays]

        self._note(at, self.length)
        in_order = np.argsort(own.astype(np.int64) * len(self.of) + at)
        line = at[in_order]
        joined = self.next[line[:-1]] == line[1:]
        left, right = self.before[line[np.append(True, ~joined)]], self.next[line[np.append(~joined, True)]]
        has = left >= 0
        self._note(left[has], self.length)
        self.next[left[has]] = right[has]
        self.since[left[has]] = self.length + 1
        has = right >= 0
        self.before[right[has]] = left[has]

        # Moved members go to the end of their class's stretch, the others there to the places that become free.
        head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        gone, parent = np.add.reduceat(count, head), of[head]
        tail = self.begin[parent] + self.size[parent] - gone
        slots = _ranges(tail, gone)
        self.moving[at] = True
        there = self.members[slots]
        there = there[~self.moving[there]]
        self.moving[at] = False
        free = self.place[at][self.place[at] < np.repeat(tail, gone)]
        self.members[free], self.place[there] = there, free
        self.members[slots], self.place[at] = at, slots
        self.size[parent] -= gone
        self.whole[parent] -= gone
        numbers = np.arange(self.classes, self.classes + len(count))
        self.classes += len(count)
        self.size[numbers] = self.whole[numbers] = count
        self.begin[numbers] = slots[np.cumsum(count) - count]
        group = np.repeat(numbers, count)
        self.of[at] = group
        self._chain(at, group)
        self.since[at] = self.length + 1

        left_over = self.members[_ranges(self.begin[small_rest], self.size[small_rest])]
        self.small = np.sort(np.append(at[~np.repeat(exempt, count)], left_over))

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of all squares."""
        while len(self.small):
            self.refine()
        self._note(np.arange(len(self.of), dtype=np.int32), None)
        if not self.squares:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*self.squares, strict=True))


def runs(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """Rows (start, length, period) of each text's runs of at least so many words, by start, then period."""
    number: list[int] = []
    total = 0
    for found in texts:
        known: dict[bytes, int] = {}
        number += [total + known.setdefault(w, len(known)) for w in found]
        total += len(known)
    ends = np.cumsum([len(x) for x in texts])
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not number:
        return out
    start, period = Partition(np.array(number), ends).finish()
    if not len(start):
        return out
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    text = np.searchsorted(ends, start, side="right")
    new = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])))
    last = np.append(new[1:], len(start)) - 1
    length = start[last] - start[new] + 2 * period[new]
    start, period, text = start[new], period[new], text[new]
    long = length >= shortest
    start, period, text, length = start[long], period[long], text[long], length[long]
    start = start - np.append(0, ends)[text]
    order = np.lexsort((period, start, text))
    rows = np.stack([start, length, period], axis=1)[order]
    cuts = np.searchsorted(text[order], np.arange(len(texts) + 1))
    for i in np.unique(text):
        out[i] = rows[cuts[i] : cuts[i + 1]]
    return out


def collapsed(found: list[bytes], spans: np.ndarray) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not len(spans):
        return found
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, spans[:, 0] + spans[:, 2], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1], -1)
    return [found[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _runs_of(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in in_steps(texts, lambda t: len(t or ""), STEP):
                split = [(t or "").encode().split() for t in texts[part]]
                spans = runs(split, shortest)
                kept = [None if t is None else b" ".join(collapsed(w, s)).decode() for t, w, s in zip(texts[part], split, spans, strict=True)]
                every = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
                items = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s) for s in spans])), pa.int32()), items)
                row = batch.column("row").slice(part.start, len(split))
                yield pa.RecordBatch.from_arrays([row, listed, pa.array(kept, pa.string())], ["row", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Add ``runs``, array of (start, length, period) in words by start, then period, and ``collapsed``, the words of
    the text that no run holds behind its first period, joined by one blank."""
    one = docs.select(F.struct(F.lit(0).alias("_"), *(docs[c] for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    schema = f"row {one.schema['row'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    out = one.mapInArrow(_runs_of(shortest), schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *(F.col(c).alias(unused(docs, c)) for c in ("runs", "collapsed")))


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's text: of every tenth document, by the checksum of its id, the words from some place on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(found: Column) -> Column:
        n = F.size(found)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        again = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(found, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(found, F.lit(1), a), again), " ")).otherwise("")

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, with repetitions planted in every tenth document; a null id plants none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    best = F.col("best")
    exponent = F.floor(1000 * best.length / -best.period)
    return out.select("doc_id", "n_runs", (-best.start).alias("start"), best.length.alias("length"), (-best.period).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
