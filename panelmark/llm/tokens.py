"""Token counts behind a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, tokens).  A run joins the digests of its texts to it,
encodes one text of each digest that is missing, appends those counts, and joins the counts back to the documents.  The
tokenizer digest is that of the vocabulary file, so another version of the tokenizer never meets old counts.

Content is normalised only as far as the count cannot change: a null text is the empty text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are encoded once; a null doc_id is kept
as it is; an empty table gives an empty result; other columns pass through ``token_counts``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import table, unused
from panelmark.sources.shared import shared_path

#: White_Space of Unicode, which the pre-tokenizers mean by \s.
UNICODE_SPACES = "\t-\r \x85\xa0  -     　"
#: A run of white space with the word behind it; no pre-token of a byte-level vocabulary crosses these cuts.
CHUNK = f"[{UNICODE_SPACES}]*[^{UNICODE_SPACES}]+|[{UNICODE_SPACES}]+\\Z"
#: Chunks that a worker remembers, and the characters of one at most.
MEMO, LONG = 600_000, 64


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


_LOADED: dict[str, object] = {}


def loaded(path: str):
    """The tokenizer of this worker; vocabulary files are installed with the Python of every node."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


_COUNTS: dict[str, dict[str, int]] = {}


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text, without special tokens at its ends.  Texts are cut where no pre-token can cross, and the
    counts of the pieces are remembered, so that a word is encoded once and not at each of its places."""
    import re

    encode, memo, cut = loaded(path).encode_batch_fast, _COUNTS.setdefault(path, {}), re.compile(CHUNK)
    chunks = [cut.findall(t) for t in texts]
    missing = list({c for cs in chunks for c in cs if c not in memo})
    if len(memo) + len(missing) > MEMO:
        memo.clear()
        missing = list({c for cs in chunks for c in cs})
    for at in range(0, len(missing), 4096):
        part = missing[at : at + 4096]
        memo.update(zip(part, map(len, encode(part, add_special_tokens=False)), strict=True))
    counts = [sum(map(memo.__getitem__, cs)) for cs in chunks]
    for c in missing:  # unbroken text is not worth its memory
        if len(c) > LONG:
            del memo[c]
    return counts


def in_steps(values: list, size, most: int) -> Iterator[slice]:
    """Slices of a batch that hold about ``most`` characters each."""
    start = total = 0
    for i, v in enumerate(values):
        total += size(v)
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(values):
        yield slice(start, len(values))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in in_steps(texts, len, 1_000_000):
                counts = count_tokens(path, texts[part])
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache so far; a cache that nobody has written yet is empty."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def token_counts(docs: DataFrame, cache: str, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` without their text, with n_bytes and n_tokens; the cache gains the counts of texts it lacked.  A column of
    such a name that ``docs`` has keeps it, and the new one gets underscores behind its name."""
    spark = docs.sparkSession
    digest = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text), F.lit(""))
    rest = [F.struct(*(docs[c] for c in docs.columns if c != text)).alias("row")] if len(docs.columns) > 1 else []
    keyed = docs.select(F.unhex(F.sha2(content, 256)).alias("content"), content.alias("text"), F.octet_length(content).cast("long").alias("n_bytes"), *rest)
    known = read_cache(spark, cache).where(F.col("tokenizer") == digest).select("content", F.lit(True).alias("known"))
    texts = keyed.select("content", "text")
    # One text per digest; the partial aggregation drops copies before the shuffle.
    misses = texts.join(known, "content", "left_anti").dropDuplicates(["content"])
    fresh = misses.mapInArrow(_encoded(tokenizer_path), "content binary, n_tokens long")
    fresh.select("content", F.lit(digest).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # A lost race or a rerun may have appended a digest twice, always with the same count.
    counts = read_cache(spark, cache).where(F.col("tokenizer") == digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counted = keyed.drop("text").join(counts, "content", "left")
    return counted.select(*(["row.*"] if rest else []), *(F.col(c).alias(unused(docs, c)) for c in ("n_bytes", "n_tokens")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, from an empty cache in the shared folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, shared_path(spark, "token-cache"), vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
