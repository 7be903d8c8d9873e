"""Corpus operators against brute force, on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelmark.llm import language_model as lm
from panelmark.llm import licenses, near_dup, packing, quality, search, substrings, tokens, warc
from panelmark.sources.shared import shared_path

PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    None, "", "   \n\t ", "one", "One two", "a b c d e " * 30, PASSAGE, PASSAGE + " tail", "head " + PASSAGE, PASSAGE,
    " ".join(f"u{i}" for i in range(3000)), "é ß ñ " * 20, "Licensed under the Apache License, Version 2.0. CC BY 4.0", " ".join(f"p{i}" for i in range(5, 40)),
    "line a b\nline a b\nline a b\nx y z", " ".join(f"n{i}" for i in range(100)), " ".join(f"n{i}" for i in range(98)) + " zz yy",
]
ROWS = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), i) for i, t in enumerate(TEXTS)] + [(None, PASSAGE, "en", None, 1, 0), (3, "one", "en", "s0", 3, 9)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int"


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def lower(text):
    return (text or "").encode().translate(near_dup._LOWER)


def test_removed_passages(spark, docs):
    length, first = 13, {}
    for i, t, *_ in ROWS:
        w = (t or "").split()
        for j in range(len(w) - length + 1):
            key, own = tuple(w[j : j + length]), substrings.LAST if i is None else i
            first[key] = min(first.get(key, own), own)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        w, gone = (t or "").split(), set()
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < (substrings.LAST if i is None else i):
                gone |= set(range(j, j + length))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = substrings.remove_repeats(docs, 13)
    assert collections.Counter((r.doc_id, r.repeat_words, r.repeat_removed, r.repeat_sha256) for r in got.collect()) == want
    assert got.columns[:6] == docs.columns and substrings.remove_repeats(docs.limit(0), 13).count() == 0


def test_near_duplicates(spark, docs):
    sets = [set() if not (w := lower(t).split()) else {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} for _, t, *_ in ROWS]
    at = list(range(len(ROWS)))
    for _ in ROWS:
        for a in range(len(ROWS)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    at[a] = at[b] = min(at[a], at[b])
    low = {c: min((ROWS[i][0] for i in range(len(ROWS)) if at[i] == c and ROWS[i][0] is not None), default=None) for c in set(at)}
    want = collections.Counter((ROWS[i][0], len(sets[i]), low[at[i]]) for i in range(len(ROWS)))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 3, 85).collect()) == want
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """200 nodes in a row, in order of their numbers and at random."""
    rng, rounds, stored = np.random.default_rng(5), [], near_dup.stored
    monkeypatch.setattr(near_dup, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    for order in (np.arange(200), rng.permutation(200)):
        rounds.clear()
        edges = spark.createDataFrame([(int(min(a, b)), int(max(a, b))) for a, b in zip(order, order[1:], strict=False)] + [(500, 501)], "a long, b long").coalesce(1)
        got = {r.node: r.component for r in near_dup.connected(edges).collect()}
        assert got == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}
        assert sum(x.endswith("-step") for x in rounds) <= 24 and sum(x.endswith("-edges") for x in rounds) <= 8


def near_texts(rng, families, size):
    """Texts of 60 words; each family's differ in a few words from the one before, so links form chains and clusters."""
    out = []
    for f in range(families):
        w = [f"f{f}w{i}" for i in range(60)]
        for _ in range(size):
            w = list(w)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, 60))] = f"x{int(rng.integers(0, 1 << 30))}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_of_families_in_blocks(spark, monkeypatch, exact):
    """Blocks of few rows: components of every size share and fill blocks; against all pairs."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    texts = near_texts(np.random.default_rng(2), 4, 30)
    sets = [{tuple(t.split()[j : j + 3]) for j in range(58)} for t in texts]
    at = list(range(len(texts)))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                at[high] = low
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 3, 85, exact=exact).collect()}
    assert got == {i: top(i) for i in range(len(texts))} and 4 < len(set(got.values())) < len(texts)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        p = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 80), dtype=np.uint64))
        q = np.unique(np.concatenate((p[rng.random(len(p)) > 0.08], rng.integers(0, 1 << 40, rng.integers(0, 6), dtype=np.uint64))))
        if len(q) and near_dup.similar(p, q, 85):
            assert set(near_dup.prefix(p, 85).tolist()) & set(near_dup.prefix(q, 85).tolist())


def test_token_counts_and_cache(spark, docs):
    path, cache = tokens.vocabulary("byte_bpe_50k.json"), shared_path(spark, "cache")
    t = tokens.loaded(path)
    odd = ["a  b\n\n c ", "<|endoftext|> x<|endoftext|>", "it's  I'll x   y", "\x1c a\x85b "]
    assert tokens.count_tokens(path, odd) == [len(t.encode(x, add_special_tokens=False).ids) for x in odd]
    want = collections.Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in ROWS)
    for _ in range(2):
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, cache, path).collect()) == want
        assert tokens.read_cache(spark, cache).count() == len({x or "" for _, x, *_ in ROWS})  # nothing is encoded twice


def test_packing(spark, docs):
    path = tokens.vocabulary("word_bpe_49k.json")
    t = tokens.loaded(path)
    want = collections.Counter()
    for i, x, *_ in ROWS:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        for n, a in enumerate(range(0, len(ids), 2048)):
            want[(i, n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += 1
    got = packing.pack_documents(docs, path).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in map(sorted, by.values()):
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(v[-1]) <= 2048
    assert len(by) == packing.lower_bound(np.array([r.length for r in got]), 2048)


def test_encoder_gives_the_library_s_ids(monkeypatch):
    path, rng = tokens.vocabulary("word_bpe_49k.json"), np.random.default_rng(3)
    signs = [chr(i) for i in range(256)] + list("'''  stredvml\n\t") * 8
    wide = signs + list("“”—…日本語\u0301\u200b İΣς½Ⅷ") * 6
    texts = ["".join(rng.choice(x, rng.integers(0, 60))) for x in [signs, wide] * 300] + [a + chr(i) + b for i in range(256) for a, b in (("", ""), ("a", "b"), ("1", "'s"))]
    texts += ["a <|endoftext|> b", "é<|startoftext|>y z", "日<|endoftext|>", *(t for t in TEXTS if t)]
    library = tokens.loaded(path).encode_batch(texts, add_special_tokens=False)
    want = [np.array(e.ids, "<u4").tobytes() for e in library]
    assert [packing.encoded(path, t) for t in texts] == want
    monkeypatch.setattr(packing, "SPAN", 5)
    monkeypatch.setattr(packing, "MEMO", 50)
    assert [packing.encoded(path, t) for t in texts] == want
    # A vocabulary of other settings gets no short cut.
    other = packing.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    assert not other.known and other("Don't  stop it's") == np.array(other.tokenizer.encode("Don't  stop it's").ids, "<u4").tobytes()


def test_lower_bound_never_exceeds_packing():
    rng = np.random.default_rng(0)
    for high in (300, 900, 2048):
        sizes = rng.integers(1, high, 400)
        assert packing.lower_bound(sizes, 2048) <= len(packing.best_fit_decreasing(sizes, 2048)[2])
    assert packing.lower_bound(np.full(9, 1025), 2048) == 9


def test_warc_splits_own_each_record_once(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", t, 0) for i, t in enumerate(TEXTS)] + [(None, None, "only", 1), (99, "u", "\x1f\x8b\x08 not a member" * 50, 2)], "page_id long, url string, html string, size int")
    for split in (1, 200, 1 << 20):
        folder = shared_path(spark, "warc")
        got = warc.read_archives(warc.write_archives(pages, folder, archive_bytes=700), folder, split_bytes=split).where("record_type <> 'warcinfo'").collect()
        assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((r.page_id is None, r.page_id or 0) for r in pages.collect())
        by = {r.page_id: r for r in got}
        assert (by[6].record_type, by[6].refers_to, by[9].record_type) == ("revisit", 9, "response")
        assert (by[0].record_type, by[0].refers_to, by[1].record_type, by[2].record_type) == ("revisit", 1, "response", "response")
        assert by[8].payload.decode() == TEXTS[8] and by[6].payload_bytes == len(PASSAGE) and by[8].digest_ok
    folder = shared_path(spark, "warc")
    got = warc.read_archives(warc.write_archives(pages, folder, least=5), folder).collect()
    assert {r.page_id for r in got if r.record_type == "revisit"} == {6} and {r.page_id: r.record_type for r in got}[0] == "response"
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def raw_record(kind, block, extra="", record_id="<urn:uuid:1>", pack=warc.member):
    return pack(f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{extra}Content-Length:  {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def test_warc_archives_of_others(spark, tmp_path):
    """Record types without payload digest or target; stored members and broken headers are no records."""
    import pyarrow as pa

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    nested = b"".join(raw_record("resource", b"inner%d" % i, record_id=f"<urn:uuid:inner{i}>") for i in range(3))
    noise = np.random.default_rng(9).bytes(30_000)

    def stored(content):
        deflate = zlib.compressobj(0, zlib.DEFLATED, 31)
        return deflate.compress(content) + deflate.flush()

    records = [
        raw_record("warcinfo", b"software: x\r\n"),
        raw_record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: <http://a/>\r\nContent-Type: application/http; msgtype=request\r\n"),
        raw_record("response", http, "WARC-Target-URI: http://a/\r\nContent-Type: application/http;\r\n msgtype=response\r\nWARC-Payload-Digest: md5:x\r\n"),
        raw_record("resource", noise[:2000] + nested + noise, "Content-Type: application/octet-stream\r\n", pack=stored),
        raw_record("metadata", b""),
        raw_record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:7>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:ABC\r\n"),
    ]
    whole = b"".join(records)
    (tmp_path / "x.warc.gz").write_bytes(whole)
    archives = spark.createDataFrame([("x.warc.gz", len(whole))], "name string, size long")
    for split in (1000, 10_000, 1 << 20):
        got = warc.read_archives(archives, str(tmp_path), split_bytes=split).collect()
        assert sorted(r.record_type for r in got) == ["metadata", "request", "resource", "response", "revisit", "warcinfo"]
    by = {r.record_type: r for r in got}
    assert (by["response"].payload, by["response"].payload_digest, by["response"].digest_ok) == (b"body", warc.base32_sha1(b"body"), None)
    assert (by["revisit"].payload, by["revisit"].payload_bytes, by["revisit"].payload_digest, by["revisit"].refers_to_id) == (None, None, "ABC", "urn:uuid:7")
    assert by["request"].url == "http://a/" and by["metadata"].payload_bytes == 0 and by["warcinfo"].url is None
    source = pa.BufferReader(whole)
    assert nested in whole  # the stored members stand in the archive as they are
    places = [whole.find(x) for x in records]
    assert [warc.member_at(source, p, len(whole)) is not None for p in places] == [True] * 6
    assert warc.headers_of(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 1\r\n\r\na\r\n\r\n") is None
    assert warc.headers_of(b"WARC/1.0\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\nWARC-Date: z\r\nContent-Length: 9\r\n\r\na\r\n\r\n") is None


def test_exact_search(spark):
    rng = np.random.default_rng(1)
    vs = [[float(x) for x in rng.normal(size=6).astype("float32")] for _ in range(300)]
    vs[7] = vs[50]
    rows = [(i, v, 0) for i, v in enumerate(vs)] + [(400, None, 0), (450, [1.0, None], 0), (500, [float("nan")] * 6, 0), (50, vs[50], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int").repartition(3)
    q = [(i, np.floor(256.0 * np.array(v, float)).astype(int)) for i, v, _ in rows if v and None not in v and not np.isnan(v).any()]
    want = []
    for n, (i, a) in enumerate(q):
        if i % 50 == 0:
            best = sorted((-int(a @ b), j) for m, (j, b) in enumerate(q) if m != n)[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in search.top_k(df).collect()) == sorted(want)
    assert search.top_k(df.where("vec_id = 400")).count() == 0


def test_search_stops_where_vectors_lie_in_clusters(spark):
    """The same results as by brute force, from a fraction of the pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    vs = np.concatenate([c + rng.normal(size=(100, 16)) * 0.2 for c in centres])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "vec_id long, embedding array<double>").repartition(3)
    scored = []
    got = sorted(tuple(r) for r in search.top_k(df, scored=scored).collect())
    q = np.floor(256 * vs).astype(int)
    want = []
    for i in range(0, len(q), 50):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(len(q)) if j != i)[:5]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(order, 1)]
    assert got == sorted(want)
    assert sum(scored) < 0.4 * len(q) * len(q) / 50 and len(scored) >= 2


def test_language_model_words(spark, docs):
    got = lm.score_texts(docs, F.coalesce("doc_id", F.lit(0)) % 2 == 0, top=3).collect()
    c = collections.Counter()
    for i, t, *_ in ROWS:
        if (i or 0) % 2 == 0:
            c.update([*lower(t).split(), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        w = [*lower(t).split(), None]
        want[(i, len(w), sum(c[x] > 0 for x in w), round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want


def brute_license(text, templates, k=5, cover=0.6, drift=8):
    """Base values and labels of one text by definition: every pair of places, diagonals in order, slow chains."""
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
    starts = sorted(i for x in base.values() for i in x)
    labels = {x for x, v in base.items() if v}
    score = 1.0 if starts else 0.0
    for name, template in templates.items():
        t = [w.decode() for w in licenses.license_words(template)]
        by = collections.defaultdict(list)
        for p in range(len(words) - k + 1):
            for q in range(len(t) - k + 1):
                if words[p : p + k] == t[q : q + k]:
                    by[p - q].append((p, q))
        groups, last = [], None
        for d in sorted(by):
            if last is None or d - last > min(drift, len(t) / 4):
                groups.append([])
            groups[-1] += by[d]
            last = d
        for hits in groups:
            hits.sort()
            best = []
            for i, (p, q) in enumerate(hits):
                best.append(max([best[j] for j in range(i) if hits[j][0] < p and hits[j][1] < q], key=len, default=[]) + [(p, q)])
            longest = max(map(len, best))
            for c in [x for x in best if len(x) == longest][:1]:
                here, there = {p + i for p, _ in c for i in range(k)}, {q + i for _, q in c for i in range(k)}
                if len(there) >= cover * len(t) and max(here) + 1 - min(here) - len(here) <= (1 - cover) * len(t):
                    labels.add(name)
                    score = max(score, len(there) / len(t))
    return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(x for x, v in base.items() if v)), ",".join(sorted(labels)), round(score, 9)


def test_license_scan_against_all_pairs(spark, tmp_path):
    text = licenses.TEMPLATES["mit-text"]
    w, line, rng = text.split(), licenses.TEMPLATES["apache-line"], np.random.default_rng(0)
    spread = " ".join(x for i in range(0, len(w), 6) for x in [*w[i : i + 6], *["und"] * 5])
    texts = [
        "x y " + text, " ".join(w[:40] + ["really", "so"] + w[40:]), " ".join(w[:12]), " ".join(w[:20] + w[26:]), " ".join(w[30:] + w[:30]), spread, (line + " ") * 5,
        "Apache License and GNU General\nPublic License; cc-by cc by", None, "", " \n", "apachelicense", text + " " + text, line.upper(), " ".join(["lorem"] * 3000) + " " + text,
        " ".join(w[int(i) : int(i) + 7][0] for i in rng.integers(0, len(w), 200)), *(" ".join(x for x in w if rng.random() > 0.03) for _ in range(6)), *TEXTS,
    ]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, text, "z"), (0, texts[0], "z")]
    spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.op3_license_scan(spark, str(tmp_path)).collect())
    assert got == collections.Counter((i, *brute_license(t, licenses.TEMPLATES)) for i, t, _ in rows)
    of = {r[0]: r[6] for r in got}
    assert "mit-text" in of[0] and "mit-text" in of[1] and "mit-text" in of[3] and "mit-text" not in of[2] + of[4] + of[5] and "apache-line" in of[6]
    assert licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, label string").limit(0))[0].count() == 0


def test_quality_cascade_keeps_what_no_rule_rejects(spark, docs):
    kept = {r.doc_id for r in quality.quality_cascade(docs).where("failed_rule is null").collect()}
    assert 10 in kept and 15 in kept and not kept & {0, 1, 2, 3, 5}
    orders = [quality.quality_cascade(docs, tuple(x)).where("failed_rule is null").count() for x in (quality.RULES, quality.RULES[::-1])]
    assert orders[0] == orders[1]
    assert quality.quality_cascade(docs.limit(0)).count() == 0
    named = quality.quality_cascade(docs.withColumn("Failed_rule", F.lit(7)))
    assert named.columns[-2:] == ["Failed_rule", "failed_rule_"] and {r[-2] for r in named.collect()} == {7}


def test_quality_cascade_asks_rejected_texts_no_further(spark, monkeypatch):
    """A statistic that fails on the texts that the first rule rejects is never computed for them."""
    texts = ["a b"] * 3 + [" ".join(f"w{i}" for i in range(30))] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setitem(quality.STATISTICS, "picky", lambda text, found: F.when(F.size(found) < 20, F.raise_error(F.lit("asked"))).otherwise(F.lit(1)).cast("long"))
    short, picky = quality.RULES[0], quality.Rule("picky", lambda s: s("picky") < 1)
    monkeypatch.setattr(quality, "ordered", lambda docs, rules, text: list(rules))
    assert [r.failed_rule for r in quality.quality_cascade(df, (short, picky)).orderBy("doc_id").collect()] == ["few_words"] * 3 + [None] * 2
    with pytest.raises(Exception, match="asked"):
        quality.quality_cascade(df, (picky, short)).collect()


def test_quality_order_follows_rejection_per_cost(spark, monkeypatch):
    rules = quality.RULES[:3]
    figures = {"few_words": (2.0, 0.2), "repeated_words": (4.0, 0.9), "symbols": (1.0, 0.0)}
    monkeypatch.setattr(quality, "estimates", lambda *_: figures)
    assert [r.name for r in quality.ordered(None, rules)] == ["repeated_words", "few_words", "symbols"]


def test_pipeline_stages(spark, docs):
    rows = docs.drop("label")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "").select("*").cache()
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id for r in rows.collect()}
    assert kept and 9 not in kept
    assert corpus_pipeline.packing(spark, rows, "").agg(F.sum("length")).first()[0] > 0


def test_mixing_stage_meets_targets(spark):
    """Sources above and below their target; each keeps the documents that its keys and its budget ask for."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40 + i % 7)), "en", f"s{i % 3}", 0) for i in range(360)]
    rows = [r for r in rows if r[3] != "s0" or r[0] < 90]  # the source of weight 5 is small, the one of weight 1 large
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    size, source = {r[0]: len(r[1].split()) for r in rows}, {r[0]: r[3] for r in rows}
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in ("s0", "s1", "s2")}
    weight, left, target = {"s0": 5.0, "s1": 2.0, "s2": 1.0}, 1.5 * sum(total.values()), {}
    for s in sorted(total, key=lambda s: 2 * total[s] / weight[s]):
        target[s] = min(2.0 * total[s], left * weight[s] / sum(w for x, w in weight.items() if x not in target))
        left -= target[s]
    assert target["s2"] < total["s2"] and target["s0"] == 2 * total["s0"]

    def key(i, text):
        u = (int(hashlib.md5(f"{i}|mix".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        return -np.log(u) / max(0.1, sum(c not in "0123456789#*$%&|<>{}=_~^" for c in text) / len(text))

    want = collections.Counter()
    for s in total:
        whole, place = int(target[s] // total[s]), 0
        rest = round(target[s] - whole * total[s])
        for _, i in sorted((key(r[0], r[1]), r[0]) for r in rows if r[3] == s):
            part = min(size[i], max(0, rest - place))
            place += size[i]
            want[i] += whole + (part > 0 and 2 * part >= size[i])
    got = collections.Counter(r.doc_id for r in corpus_pipeline.mixing(spark, docs, "").collect())
    assert got == +want
    for s in total:
        assert abs(sum(n * size[i] for i, n in got.items() if source[i] == s) - target[s]) <= 46


def test_language_model_mixes_all_depths(spark):
    """Against a recursive tree; contexts longer than three bytes count."""
    texts = ["the cat sat on the mat", "The cat ate", None, "abcdefgh abcdefgh abcdefxh", "the cat sat on the mat", "qz abcdefgh", "\xe9t\xe9", "", "the cot sat"]
    learn = [i % 4 != 0 for i in range(len(texts))]
    counts = collections.defaultdict(lambda: [0, 0])

    def coded(text):
        b = bytes(lm.DEPTH) + lower(text) + b"\0"
        for j in range(lm.DEPTH, len(b)):
            for k in range(8):
                yield b[j - lm.DEPTH : j][::-1], 1 << k | b[j] >> (8 - k), b[j] >> (7 - k) & 1

    for t, own in zip(texts, learn, strict=True):
        for context, node, bit in coded(t) if own else ():
            for d in range(lm.DEPTH + 1):
                counts[context[:d], node][bit] += 1
    children = collections.defaultdict(set)
    for c, v in list(counts):
        if c:
            children[c[:-1], v].add(c)

    def own(c, v):
        z, o = counts[c, v] if (c, v) in counts else (0, 0)
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi), (o + 0.5) / (z + o + 1)

    def parts(c, v):
        return own(c, v)[0], sum(ln(x, v) for x in children.get((c, v), ()))

    def ln(c, v):
        a, b = parts(c, v)
        return a if len(c) == lm.DEPTH else math.log(0.5) + np.logaddexp(a, b)

    def one(context, v, d=0):
        c = context[:d]
        if d == lm.DEPTH:
            return own(c, v)[1]
        a, b = parts(c, v)
        share = 1 / (1 + math.exp(b - a))
        return share * own(c, v)[1] + (1 - share) * one(context, v, d + 1)

    want = [sum(math.log10(p if bit else 1 - p) for context, v, bit in coded(t) for p in [one(context, v)]) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in lm.score_texts(df, F.col("doc_id") % 4 != 0).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-4)
    assert lm.DEPTH >= 5 and lm.score_texts(df.limit(0), F.lit(True)).count() == 0


CLASHING = ["kept_id", "kept_hash", "repeat_first", "repeat_words", "target", "Source_size", "epochs", "taken", "part", "size", "row", "key", "mix_copy", "mix_words", "failed_rule", "content", "n_tokens", "node", "lead", "starts", "packed", "copy"]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(7) for c in CLASHING}).cache()


def test_other_columns_pass_through_whatever_their_names(spark, clashing):
    path = tokens.vocabulary("byte_bpe_50k.json")
    sized = clashing.withColumn("Weight", F.lit(1.0))
    found = {
        "mix": __import__("panelmark.llm.mixing", fromlist=["mix"]).mix(sized, "n_chars", "weight"),
        "repeats": substrings.remove_repeats(clashing, 13),
        "quality": quality.quality_cascade(clashing),
        "tokens": tokens.token_counts(clashing, shared_path(spark, "cache"), path),
    }
    for name, df in found.items():
        rows = df.select(*CLASHING).distinct().collect()
        assert [tuple(r) for r in rows] == [(7,) * len(CLASHING)], name
        assert df.count() == len(ROWS) and len({c.lower() for c in df.columns}) == len(df.columns), name
    assert {"target_", "taken_", "epochs_", "part_"} <= set(found["mix"].columns) and "n_tokens_" in found["tokens"].columns and "repeat_words_" in found["repeats"].columns
    assert near_dup.near_duplicates(clashing).count() == licenses.license_scan(clashing)[0].count() == len(ROWS)


def test_empty_tables_give_empty_results(spark, docs):
    none = docs.limit(0)
    path = tokens.vocabulary("byte_bpe_50k.json")
    assert tokens.token_counts(none, shared_path(spark, "cache"), path).count() == 0
    assert packing.pack_documents(none, tokens.vocabulary("word_bpe_49k.json")).count() == 0
    from panelmark.llm.mixing import mix

    assert mix(none.withColumn("w", F.lit(1.0)), "n_chars", "w").count() == 0
    rows = none.drop("label")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "")
        assert rows.count() == 0


def test_mix_against_brute_force(spark, docs):
    """Targets level by level, keys and prefix sums in plain Python, on nulls, ties and repeated rows."""
    from panelmark.llm.mixing import mix, quality_weight

    size = lambda t: len((t or "").split())
    sized = docs.withColumn("w", quality_weight(F.col("text"))).withColumn("words", F.size(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")))
    sized = sized.withColumn("words", F.when(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")) == "", 0).otherwise(F.col("words")))
    got = collections.Counter((r.doc_id, r.words, r.source_size, round(r.target, 6), r.taken) for r in mix(sized, "words", "w").collect())
    names = sorted({r[3] for r in ROWS if r[3] is not None}) + [None]
    total = {s: sum(size(r[1]) for r in ROWS if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), list(names)
    while free:  # those above their cap stop there; the rest share anew
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s] + 1e-9]
        for s in over or free:
            target[s] = 2.0 * total[s] if over else level * weight[s]
            left -= target[s]
        free = [s for s in free if s not in target]

    def key(i, t):
        u = (int(hashlib.md5(f"{'' if i is None else i}|mix".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        return -np.log(u) / max(0.1, sum(c not in "0123456789#*$%&|<>{}=_~^" for c in t or "") / max(1, len(t or "")))

    want = collections.Counter()
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        place, rest = 0, round(target[s] - epochs * total[s])
        for r in sorted((r for r in ROWS if r[3] == s), key=lambda r: (key(r[0], r[1]), r[0] is not None, r[0] or 0, size(r[1]))):
            n = size(r[1])
            want[(r[0], n, total[s], round(target[s], 6), epochs * n + min(n, max(0, rest - place)))] += 1
            place += n
    assert got == want


def test_packing_of_many_partitions_meets_the_bound(spark):
    """Certified partitions merge their open sequences with others'."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 3000).tolist()
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "row long, length long").repartition(3)
    packed = packing.pack(pieces, part_rows=250).join(pieces, "row")
    by = collections.defaultdict(list)
    for r in packed.collect():
        by[r.sequence_id].append((r.offset, r.length))
    for v in map(sorted, by.values()):
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(v[-1]) <= 2048
    used, bound = packing.certificate(packed)
    assert used == len(by) and sum(map(len, by.values())) == 3000 and bound == -(-sum(sizes) // 2048) and used <= bound + 1


def test_memos_keep_no_long_pieces():
    from panelmark.llm import common

    path = tokens.vocabulary("byte_bpe_50k.json")
    long = "x" * 5000
    assert tokens.count_tokens(path, [long, long + " a"]) == [len(tokens.loaded(path).encode(x, add_special_tokens=False).ids) for x in (long, long + " a")]
    assert not [c for c in tokens._COUNTS[path] if len(c) > tokens.LONG]
    common.word_hashes([long.encode(), b"a"])
    assert long.encode() not in common._HASHES and b"a" in common._HASHES


def brute_quality(text):
    """The rules in plain Python; True if the text is kept."""
    import re

    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(w), sum(map(len, w))
    grams = collections.defaultdict(list)
    for i in range(n - 7):
        grams[tuple(w[i : i + 8])].append(i)
    repeated = len({i + o for v in grams.values() if len(v) > 1 for i in v for o in range(8)})
    symbols, letters = sum(c in "#*$%&|<>" for c in text or ""), sum(any(c.isalpha() for c in x) for x in w)
    cut = sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines)
    bad = n < 20 or 100 * repeated > 30 * n or 100 * symbols > 10 * chars or len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
    bad = bad or chars < 2 * n or chars > 25 * n or 100 * letters < 60 * n or n >= 100 and len(set(w)) ** 2 < 9 * n or len(lines) >= 4 and 100 * cut > 60 * len(lines)
    return not bad


def brute_near(rows):
    """One row of each group: that with the smallest id; of rows equal in id and text, one."""
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := lower(t).split()) else frozenset() for _, t, *_ in rows]
    at = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and at[a] != at[b]:
                    at[a] = at[b] = min(at[a], at[b])
                    changed = True
    keep = {}
    for i, r in enumerate(rows):
        best = keep.get(at[i])
        if best is None or (r[0] is not None and (rows[best][0] is None or r[0] < rows[best][0])):
            keep[at[i]] = i
    return [rows[i] for i in sorted(keep.values())]


def brute_substrings(rows, length=50):
    import re

    last, first, out = 1 << 62, {}, []
    for i, t, *_ in rows:
        w = (t or "").split()
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            first[key] = min(first.get(key, last), last if i is None else i)
    for i, t, lang, source, n in rows:
        w, gone = (t or "").split(), set()
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < (last if i is None else i):
                gone |= set(range(j, j + length))
        if w and len(gone) == len(w):
            continue
        if gone:
            places = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] + [len(t)]
            t = t[: places[0]] + "".join(t[places[k] : places[k + 1]] for k in range(len(w)) if k not in gone)
            n = len(t)
        out.append((i, t, lang, source, n))
    return out


def brute_mix(rows):
    size = lambda t: len((t or "").split())
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s] + 1e-9]
        for s in over or free:
            target[s] = 2.0 * total[s] if over else level * weight[s]
            left -= target[s]
        free = [s for s in free if s not in target]

    def key(i, t):
        u = (int(hashlib.md5(f"{'' if i is None else i}|mix".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        return -np.log(u) / max(0.1, sum(c not in "0123456789#*$%&|<>{}=_~^" for c in t or "") / max(1, len(t or "")))

    out = []
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        place, rest = 0, round(target[s] - epochs * total[s])
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (key(r[0], r[1]), r[0] is not None, r[0] or 0)):
            part = min(size(r[1]), max(0, rest - place))
            place += size(r[1])
            out += [r] * (epochs + (part > 0 and 2 * part >= size(r[1])))
    return out


def pipeline_rows():
    rng = np.random.default_rng(11)
    prose = lambda n, tag: " ".join(f"{tag}{''.join(chr(97 + int(c)) for c in rng.integers(0, 26, 4))}" for _ in range(n))
    passage = prose(70, "p")
    texts = [prose(int(rng.integers(30, 200)), "w") for _ in range(40)]
    texts += [texts[3], texts[5] + " tail", " ".join(texts[7].split()[:-1] + ["other"]), texts[3]]
    texts += [prose(60, "h") + " " + passage + "\n" + prose(40, "t") for _ in range(4)] + [passage, prose(30, "m") + "  " + passage]
    texts += [None, "", "few words", "ab cd " * 60, "## $$ && " * 30 + prose(20, "s"), "\n".join([prose(6, "l")] * 8), prose(2500, "long"), "1 2 3 4 5 " * 3 + prose(10, "d")]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, prose(50, "n"), None, "s1", 3), rows[2], (3, prose(50, "q"), "en", "s2", 9)]


def test_pipeline_against_brute_force(spark):
    """Every stage's rows, each stage on what the one before kept."""
    rows = pipeline_rows()
    names, path = "doc_id long, text string, lang string, source string, n_chars int", tokens.vocabulary("word_bpe_49k.json")
    brute = [lambda x: [r for r in x if brute_quality(r[1])], brute_near, brute_substrings, brute_mix]
    docs = spark.createDataFrame(rows, names).repartition(3)
    for (name, stage), slow in zip(corpus_pipeline.STAGES, brute, strict=False):
        kept = slow(rows)
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), names).repartition(3)
        assert collections.Counter(map(tuple, docs.collect())) == collections.Counter(kept), name
        assert name == "mixing to target weights" or 0 < len(kept) < len(rows), name
        rows = kept
    t, want = tokens.loaded(path), collections.Counter()
    for i, x, *_ in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        for n, a in enumerate(range(0, len(ids), 2048)):
            want[(i, n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += 1
    got = corpus_pipeline.packing(spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in map(sorted, by.values()):
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(v[-1]) <= 2048
    assert len(by) == packing.lower_bound(np.array([r.length for r in got]), 2048)
