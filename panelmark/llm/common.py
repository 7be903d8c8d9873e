"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.functions.text import let  # noqa: F401
from panelmark.sources.shared import shared_path

#: The white space of the word rules: blank and \t \n \v \f \r.  ``bytes.split()`` cuts at the same six bytes.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` whose readers are all stored themselves."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of steps whose results are already stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it as long as ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(docs: DataFrame, *needed: str, row: str = "row") -> DataFrame:
    """The needed columns beside a struct of all columns, so that no other name can clash; ``row.*`` has them back."""
    return docs.select(*needed, F.struct(*(docs[c] for c in docs.columns)).alias(row))


class WordHashes(dict):
    """Memo of 64-bit hashes of words of up to ``LONG`` bytes; emptied when full, so its memory is bounded."""

    LIMIT, LONG = 400_000, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers (finaliser of MurmurHash3, public domain)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, by start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mixed(out + h[j : j + n])
    return out
