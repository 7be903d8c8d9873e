"""Ratings that arrive as a stream."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from panelmark.operators.keys import unused
from panelmark.operators.metrics import pattern_metrics
from panelmark.operators.pairs import CALL
from panelmark.operators.votes import ITEM


def stream_intake(stream: DataFrame, path: str, checkpoint: str, key=CALL, event_time: str = "ingest_ts", delay: str = "1 hour") -> StreamingQuery:
    """Append each call once.  Inside the watermark the first write of a key wins, unlike the batch rule (the last one):
    a stream cannot wait for a later correction.  Keys older than the watermark leave the state."""
    fresh = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State of any kind, with timers, needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The setting holds for queries that start inside; the session gets its own back."""
    name, value = STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LatestWrite(StatefulProcessor):
    """The last write of a key, by (time, sequence, content); it leaves when the watermark passes its time."""

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, sequence long, payload string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        known = tuple(self.latest.get()) if self.latest.exists() else None
        best = known
        for frame in rows:
            for row in zip(frame["at"].tolist(), frame["sequence"].tolist(), frame["payload"].tolist(), strict=True):
                best = row if best is None or row > best else best
        if best is not None and best != known:
            if known is not None:
                self.handle.deleteTimer(_millis(known[0]))
            self.latest.update(best)
            self.handle.registerTimer(_millis(best[0]))
        yield pd.DataFrame({"payload": pd.Series([], dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        if self.latest.exists():
            payload = self.latest.get()[2]
            self.latest.clear()
            yield pd.DataFrame({"payload": [payload]})

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    return -(-int(micros) // 1000)


def stream_latest(stream: DataFrame, path: str, checkpoint: str, key=CALL, event_time: str = "ingest_ts", delay: str = "1 hour", sequence: str | None = None) -> StreamingQuery:
    """Append each call once, with its last write inside the delay: a correction replaces what came before, as in the
    batch rule (``latest_call``).

    A call waits in the state until the watermark (the latest time seen less ``delay``) passes its last write; it is then
    written and its state dropped, so the state holds a delay's worth of calls.  A write that comes after that, but not
    behind the watermark, is a call of its own; a reader of the log takes the last.  Writes behind the watermark are
    dropped.  Ties of the time go by ``sequence``, then by content."""
    fields = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    names = [unused(stream, f"key_{i}") for i in range(len(key))]
    rows = stream.withWatermark(event_time, delay).select(
        *(F.col(k).alias(n) for k, n in zip(key, names, strict=True)),
        F.col(event_time),
        F.unix_micros(F.col(event_time).cast("timestamp")).alias("at"),
        (F.col(sequence).cast("long") if sequence else F.lit(0).cast("long")).alias("sequence"),
        F.to_json(F.struct(*(F.col(c) for c in stream.columns)), fields).alias("payload"),
    )
    kept = rows.groupBy(*names).transformWithStateInPandas(LatestWrite(), outputStructType="payload string", outputMode="Append", timeMode="EventTime")
    whole = kept.select(F.from_json("payload", stream.schema, fields).alias("row")).select("row.*")
    with state_store(stream.sparkSession):
        return whole.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: Parts of a group's items; each is one value of the state.
BUCKETS = 1024


def _moved(key, frames, state):  # noqa: ANN001, ANN202
    """Items of a bucket leave their patterns (n labels, h of them HIGH) for others: a row per pattern that changes."""
    votes = {c: (n, h) for c, n, h in zip(*state.get, strict=True)} if state.exists else {}
    before: dict[str, tuple[int, int]] = {}
    for frame in frames:
        for code, high in zip(frame["code"].tolist(), frame["is_high"].tolist(), strict=True):
            n, h = votes.get(code, (0, 0))
            before.setdefault(code, (n, h))
            votes[code] = n + 1, h + high
    state.update((list(votes), [n for n, _ in votes.values()], [h for _, h in votes.values()]))
    moves = Counter(votes[code] for code in before)
    moves.subtract(was for was in before.values() if was[0])
    out = pd.DataFrame([(n, h, items) for (n, h), items in moves.items() if items], columns=["n", "h", "items"])
    for i, value in enumerate(key[:-1]):
        out.insert(i, f"key_{i}", [value] * len(out))
    yield out


def stream_panel_patterns(stream: DataFrame, sink, checkpoint: str, keys=("domain",), item=ITEM, buckets: int = BUCKETS) -> StreamingQuery:  # noqa: ANN001
    """Changes of the pattern table that each micro-batch makes; ``sink(changes, number)`` keeps them.

    The state of the query holds an item's name and two numbers.  Items of a group are dealt to ``buckets`` by hash, so
    Python is called for each bucket and not for each item; the number must stay that of the checkpoint.  A batch reads
    the buckets of its own items only: each item leaves its old pattern (-1) and enters its new one (+1).  A replayed
    batch starts from the state before it and gives the same changes.  Late ratings are ratings like others: an item moves
    whenever one comes."""
    kinds = dict(stream.dtypes)
    code = F.to_json(F.array(*(F.col(c).cast("string") for c in item)), {"ignoreNullFields": "false"})
    names = {f"key_{i}": c for i, c in enumerate(keys)}
    valid = stream.where(F.col("label").isin("HIGH", "LOW")).select(*(F.col(c).alias(k) for k, c in names.items()), code.alias("code"), (F.col("label") == "HIGH").cast("long").alias("is_high"))
    schema = ", ".join([*(f"{k} {kinds[c]}" for k, c in names.items()), "n long, h long, items long"])
    dealt = valid.withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(buckets)))
    moves = dealt.groupBy(*names, "bucket").applyInPandasWithState(_moved, schema, "codes array<string>, n array<long>, h array<long>", "update", "NoTimeout")

    def added(batch: DataFrame, number: int) -> None:
        changes = batch.withColumnsRenamed(names).groupBy(*keys, "n", "h").agg(F.sum("items").alias("items"))
        sink(changes.where("items <> 0"), number)

    return moves.writeStream.foreachBatch(added).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_panel_votes(stream: DataFrame, sink, checkpoint: str, item=ITEM) -> StreamingQuery:  # noqa: ANN001
    """Votes that each micro-batch adds to its items; ``sink(votes, number)`` keeps them.  The running totals live in the
    sink's table and not in the state of the query, so nothing has to expire and late ratings count."""

    def added(batch: DataFrame, number: int) -> None:
        valid = batch.where(F.col("label").isin("HIGH", "LOW"))
        sink(valid.groupBy(*item).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == "HIGH").cast("long")).alias("h")), number)

    return stream.writeStream.foreachBatch(added).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunningSums:
    """Sums by group as a Parquet table of additions, one folder for each micro-batch.

    Every ``compact_every`` batches the folders so far are summed into one ``base``, and what it replaces is deleted: a
    reader sees the newest complete base and the batches behind it.  A replayed batch overwrites its own folder; one that
    a base holds already is left out."""

    group: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()

    def __init__(self, path: str, compact_every: int = 50) -> None:
        self.path, self.compact_every = path.rstrip("/"), compact_every

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base, _ = self._parts(spark)
        if base is not None and number <= base:
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        if (number + 1) % self.compact_every == 0:
            self.compact(spark)

    def _files(self, spark: SparkSession):  # noqa: ANN202
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _parts(self, spark: SparkSession) -> tuple[int | None, list[int]]:
        """(number of the newest complete base, numbers of the complete batches behind it)."""
        system, path = self._files(spark)
        if not system.exists(path):
            return None, []
        names = [x.getPath().getName() for x in system.listStatus(path)]
        whole = [x for x in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        of = lambda kind: sorted(int(x.split("-")[1]) for x in whole if x.startswith(f"{kind}-"))
        bases = of("base")
        base = bases[-1] if bases else None
        return base, [n for n in of("batch") if base is None or n > base]

    def additions(self, spark: SparkSession) -> DataFrame | None:
        """All that a refresh reads; None before the first batch."""
        base, batches = self._parts(spark)
        paths = [f"{self.path}/base-{base}"] * (base is not None) + [f"{self.path}/batch-{n}" for n in batches]
        return spark.read.parquet(*paths) if paths else None

    def totals(self, spark: SparkSession) -> DataFrame | None:
        found = self.additions(spark)
        return found if found is None else found.groupBy(*self.group).agg(*(F.sum(c).alias(c) for c in self.sums))

    def compact(self, spark: SparkSession) -> None:
        base, batches = self._parts(spark)
        if not batches:
            return
        self.totals(spark).write.mode("overwrite").parquet(f"{self.path}/base-{batches[-1]}")
        system, _ = self._files(spark)
        for name in [f"base-{base}"] * (base is not None) + [f"batch-{n}" for n in batches]:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


class PanelMetricsTable(RunningSums):
    """Votes per item, so that the metrics equal those of a batch run over all ratings so far.  A refresh folds all
    items; ``PatternTable`` does not."""

    sums = ("n", "h")

    def __init__(self, path: str, compact_every: int = 50, item=ITEM) -> None:
        super().__init__(path, compact_every)
        self.group = tuple(item)

    def votes(self, spark: SparkSession) -> DataFrame | None:
        """(item, n, h) over all batches; None before the first."""
        return self.totals(spark)

    def patterns(self, spark: SparkSession, keys=("domain",)) -> DataFrame:
        return self.votes(spark).groupBy(*keys, "n", "h").agg(F.count(F.lit(1)).alias("items"))

    def metrics(self, spark: SparkSession, keys=("domain",)) -> DataFrame:
        return pattern_metrics(self.patterns(spark, keys), keys)


class PatternTable(RunningSums):
    """How many items share a pattern, as changes of ``stream_panel_patterns``.  A refresh reads patterns, never votes:
    as many rows as there are patterns, for the base and for each batch behind it."""

    sums = ("items",)

    def __init__(self, path: str, compact_every: int = 50, keys=("domain",)) -> None:
        super().__init__(path, compact_every)
        self.keys, self.group = tuple(keys), (*keys, "n", "h")

    def patterns(self, spark: SparkSession) -> DataFrame | None:
        found = self.totals(spark)
        return found if found is None else found.where("items > 0")

    def metrics(self, spark: SparkSession) -> DataFrame:
        return pattern_metrics(self.patterns(spark), self.keys)
