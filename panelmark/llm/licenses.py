"""License scans by diagonal voting.

All rolling word k-grams of the documents are joined by their hashes to those of the license templates.  A hit at document
word p and template word q votes for the diagonal p - q.  Votes are aggregated by diagonal, and neighbouring diagonals
(words put in or left out) merge to a span.  A span is then verified: its words and the template's, compared as words and
not as hashes, are aligned (longest chain of hits that rises in both), and the span stands if the chain covers enough of
the template without more words put in than may be missing.  Fragments that lie scattered or in another order do not add
up to a license.

The templates are fixed texts of this module, so broadcasting their positions is bounded.  A worker attaches the words
of a k-gram only where its hash is one of the templates'; all other k-grams meet the join as (row, place, hash).

Base phrases are counted beside: places where the words of a phrase stand in a row.

Defined results: null and empty texts have no words, no labels and a score of 0; repeated rows are scanned each; a null
doc_id is kept; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmark.llm.common import gram_hashes, stored, table, word_hashes
from panelmark.llm.tokens import in_steps

K = 5
#: Share of a template's words that a span must hold; how far apart diagonals of one span may lie (at most a quarter of
#: the template's words).
COVER, DRIFT = 0.6, 8

#: The phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Passages that the public licenses require to be kept with copies.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def license_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII (whose UTF-8 bytes are all 0x80 or more)."""
    return _WORD.findall(text.encode().translate(_LOWER)) if text else []


def places(found: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at = [], 0
    while True:
        try:
            at = found.index(phrase[0], at)
        except ValueError:
            return out
        if found[at : at + len(phrase)] == phrase:
            out.append(at)
        at += 1


def _scan(k: int, known: np.ndarray, phrases: dict[str, str]):
    split = {label: phrase.encode().split() for phrase, label in phrases.items()}
    names = [x.split()[0] for x in SCANNED.split(", ")]

    def step(texts: list[str | None], row: pa.Array, doc_id: pa.Array) -> Iterator[pa.RecordBatch]:
        base, places_, hashes, owners, words = [], [], [], [], []
        for i, text in enumerate(texts):
            found = license_words(text)
            by_label = {label: places(found, phrase) for label, phrase in split.items()}
            starts = sorted(p for ps in by_label.values() for p in ps)
            base.append((len(found), len(starts), starts[0] if starts else None, starts[-1] if starts else None, sorted({x for x, ps in by_label.items() if ps})))
            g = gram_hashes(word_hashes(found), k)
            if len(g):
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g).tolist()
                words += [(len(hashes), at, b" ".join(found[at : at + k]).decode()) for at in hit]
                places_.append(np.arange(len(g), dtype=np.int32))
                hashes.append(g)
                owners.append(i)
        columns = list(zip(*base, strict=True)) if base else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
        n = len(base)
        yield pa.RecordBatch.from_arrays([row, doc_id, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names)
        if not hashes:
            return
        sizes = [len(x) for x in hashes]
        first = np.cumsum([0, *sizes[:-1]])
        at, n = np.concatenate(places_), sum(sizes)
        grams = np.full(n, None, object)
        for slot, place, text in words:
            grams[first[slot] + place] = text
        whose = pa.array(np.repeat(owners, sizes))
        nothing = [pa.nulls(n, t) for t in kinds]
        yield pa.RecordBatch.from_arrays([row.take(whose), doc_id.take(whose), *nothing, pa.array(at), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(grams, pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in in_steps(texts, lambda t: len(t or ""), 2_000_000):
                own = batch.slice(part.start, part.stop - part.start)
                yield from step(texts[part], own.column("row"), own.column("doc_id"))

    return run


SCANNED = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, p int, hash long, gram string"


def template_positions(spark: SparkSession, templates: dict[str, str], k: int) -> tuple[DataFrame, np.ndarray]:
    """(label, q, template_gram, hash, template_words) of all k-grams of the templates; their hashes in order."""
    rows = []
    for name, text in templates.items():
        found = license_words(text)
        hashes = gram_hashes(word_hashes(found), k).view(np.int64).tolist()
        rows += [(name, i, b" ".join(found[i : i + k]).decode(), h, len(found)) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "label string, q int, template_gram string, hash long, template_words int")
    return df, np.unique(np.array([r[3] for r in rows], np.int64).view(np.uint64))


def chain(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest list of hits (p, q) that rises in both."""
    hits = sorted(hits, key=lambda x: (x[0], -x[1]))
    tails, at, before = [], [], []
    for i, (_, q) in enumerate(hits):
        n = bisect_left(tails, q)
        before.append(at[n - 1] if n else -1)
        tails[n : n + 1] = [q]
        at[n : n + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(hits[i])
        i = before[i]
    return out[::-1]


def aligned(hits: list[tuple[int, int]], k: int, template_words: int, cover: float) -> tuple[int, int, float] | None:
    """(begin, end, share of the template covered) of a verified span, else None."""
    found = chain(hits)
    here, there = ({x + i for x in xs for i in range(k)} for xs in zip(*found, strict=True))
    begin, end = min(here), max(here) + 1
    put_in = end - begin - len(here)
    share = len(there) / template_words
    return (begin, end, share) if share >= cover and put_in <= (1 - cover) * template_words else None


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K, cover: float = COVER, drift: int = DRIFT) -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id, n_words, n_base, first_word, last_word, base; spans: row, label, begin, end, covered)."""
    positions, known = template_positions(docs.sparkSession, templates, k)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = numbered.mapInArrow(_scan(k, known, phrases), SCANNED).join(F.broadcast(positions), "hash", "left")
    # Words are compared as words: a hash alone does not vote.
    scanned = stored(scanned.where("p is null or gram = template_gram"), "license-scan")
    rows = scanned.where("p is null").select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base")
    hits = scanned.where("p is not null").select("row", "label", "p", "q", "template_words")
    votes = hits.groupBy("row", "label", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_list(F.struct("p", "q")).alias("hits"), F.min("p").alias("begin"), F.first("template_words").alias("template_words"))
    near = W.partitionBy("row", "label").orderBy("diagonal", "begin")
    far = (F.col("diagonal") - F.lag("diagonal").over(near) > F.least(F.lit(drift), F.col("template_words") / 4)).cast("int")
    merged = votes.withColumn("span", F.sum(F.coalesce(far, F.lit(1))).over(near))
    merged = merged.groupBy("row", "label", "span").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.first("template_words").alias("template_words"))
    merged = merged.where((F.size("hits") + k - 1) >= cover * F.col("template_words"))

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                found = aligned([(int(h["p"]), int(h["q"])) for h in r.hits], k, int(r.template_words), cover)
                if found:
                    out.append((r.row, r.label, *found))
            yield pd.DataFrame(out, columns=["row", "label", "begin", "end", "covered"])

    spans = merged.select("row", "label", "hits", "template_words").mapInPandas(verified, "row long, label string, begin long, end long, covered double")
    return rows, spans


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels of both kinds and the best cover of every document."""
    rows, spans = license_scan(table(spark, sf_dir, "documents"))
    best = spans.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("covered").alias("cover"))
    joined = rows.join(best, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"))
