"""Periodic runs, the filter audit and personal data against brute force, on awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.llm import filter_audit, mixing, periodic, pii, search, substrings

CARD = "4111 1111 1111 1111"
TEXTS = [
    None, "", " \n\t ", "one", "a b " * 40, "a b c " * 5 + "x " + "a b c " * 30, "w " * 300 + "v",
    " ".join(f"u{i}" for i in range(500)) + " " + " ".join(f"u{i}" for i in range(500)) + " end", "é ß ñ " * 9, "ÀB CD EF " * 60,
    f"mail x.y@mail5.example.com or +1 (017) 555-7713 {CARD} from 10.0.0.255 é {CARD}", "a|b", "a|b", "X " * 250, "tail " + "q r s t " * 70,
]
ROWS = [(i, t, f"s{i % 3}" if i % 5 else None, i, "x") for i, t in enumerate(TEXTS)] + [(None, "a|b", "s1", 1, "y"), (11, "a|b", "s2", 2, "z"), (3, "one", "s0", 3, None)]
SCHEMA = "doc_id long, text string, source string, runs int, pii string"


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.fixture
def tables(docs, tmp_path):
    """The rows as a folder of tables, with labels that repeat and that have no document."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(0, 1, 0), (4, 1, 1), (4, 0, None), (11, 1, 1), (12, None, 1), (13, 1, 0), (99, 1, 1), (None, 1, 1)]
    docs.sparkSession.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def brute_runs(w, shortest=12):
    """Stretches of words with a period that no neighbour extends, with their smallest period."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(shortest, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def brute_collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("few", [0, 16])
def test_runs_of_random_words(monkeypatch, few):
    """Few different words, with repetitions planted: by arrays alone, and with single moves."""
    monkeypatch.setattr(periodic, "FEW", few)
    rng = random.Random(few)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 5, 30, 60, 120])
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 20])) for _ in range(n)]
            for _ in range(rng.randint(0, 2) if n else 0):
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                for i in range(a + p, rng.randint(a, n)):
                    w[i] = w[i - p]
            texts.append(w)
        for shortest in (2, 12):
            assert [[tuple(r) for r in x.tolist()] for x in periodic.runs(texts, shortest)] == [brute_runs(w, shortest) for w in texts]


def test_a_position_moves_a_logarithm_of_times(monkeypatch):
    """Smaller half: moves grow as n log n on Fibonacci words, which have the most squares."""
    moved = []
    split, single = periodic.Partition._split, periodic.Partition._single
    monkeypatch.setattr(periodic.Partition, "_split", lambda self, at, behind: (moved.append(len(at)), split(self, at, behind))[1])
    monkeypatch.setattr(periodic.Partition, "_single", lambda self, i: (moved.append(1), single(self, i))[1])
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 4000:
        a, b = b, b + a
    assert [tuple(r) for r in periodic.runs([b[:400]])[0].tolist()] == brute_runs(b[:400])
    moved.clear()
    periodic.runs([b])
    assert sum(moved) <= len(b) * len(b).bit_length()


def test_periodic_runs(docs):
    got = periodic.periodic_runs(docs)
    assert got.columns == [*docs.columns, "runs_", "collapsed"]
    want = collections.Counter()
    for i, t, s, r, p in ROWS:
        found = brute_runs((t or "").split())
        want[(i, t, s, r, p, tuple(found), None if t is None else brute_collapsed(t.split(), found))] += 1
    assert collections.Counter((r.doc_id, r.text, r.source, r.runs, r.pii, tuple(tuple(x) for x in r.runs_), r.collapsed) for r in got.collect()) == want
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_of_periodic_runs(spark, docs, tables):
    want = collections.Counter()
    for i, t, *_ in ROWS:
        w, h = (t or "").split(), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, len(w))]
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(i, len(found), *best, best[1] and 1000 * best[1] // best[2], digest(lines), digest(brute_collapsed(w, found)))] += 1
    got = periodic.op11_periodic_runs(spark, tables)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(TEXTS)))


def brute_fails(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, s, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]
        yield i, s or "", dict(zip("ABCDE", bad, strict=True))


@pytest.mark.parametrize("hot", [1000, 4])
def test_filter_audit(spark, docs, tables, monkeypatch, hot):
    """All steps of all orders, by removing documents one filter after another; with and without hot keys."""
    monkeypatch.setattr(filter_audit, "HOT", hot)
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    good, toxic = ({r.doc_id for r in labels if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    fails, want = list(brute_fails(ROWS)), {}
    worth = collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {p for _, p, _ in fails}:
            left = [(i, f) for i, p, f in fails if p == part]
            every = left
            for step, c in enumerate(order, 1):
                out, left = [x for x in left if x[1][c]], [x for x in left if not x[1][c]]
                worth[part, c] += len(out)
                want[part, "".join(order), step] = (len(left), len(out), sum(f[c] for _, f in every) - len(out), sum(f[c] and sum(f.values()) == 1 for _, f in every), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out))
    got = filter_audit.op12_filter_audit(spark, tables).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got} == want
    assert len(got) == len(want) == 600 * 4 and "" in {r.part for r in got}
    assert all(r.shapley == worth[r.part, r.filter_order[r.step - 1]] for r in got)
    empty = filter_audit.failure_patterns(docs.limit(0), spark.read.parquet(f"{tables}/labels.parquet"))
    assert filter_audit.filter_interactions(empty).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            x, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda x=x: all(int(v) <= 255 for v in x.split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and brute_luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}
            if ok[kind]():
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def carded(rng):
    """Digits that pass Luhn's check."""
    body = "".join(rng.choice("0123456789") for _ in range(rng.randint(13, 18)))
    return next(body + c for c in "0123456789" if brute_luhn(body + c))


def test_base_spans_of_random_texts(spark, tables, tmp_path):
    """Texts of few kinds of characters and pieces, so that matches meet, fail, touch and repeat."""
    rng = random.Random(3)
    pieces = ["a@b.c", "@", "x_y@z-1.q.", ".", "+", "-", " ", "(", ")", "7", "255", "256", "00012", "1.2.3.4", "é", "😀", "_", "%", "ab", "+1 (234) 555-1234", "\n", CARD]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.8 else carded(rng) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["1.2.3.4 " * 1000, "a@b.cd_e@f.g" * 300, "9" * 5000, "x" * 20000 + "@", "+1-" * 700, CARD * 300, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/random/documents.parquet")
    got = pii.op13_personal_data(spark, f"{tmp_path}/random")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    seen = collections.Counter()
    for r in got.collect():
        want = brute_spans(texts[r.doc_id])
        seen.update(x.split(":")[0] for x in want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in want) for k in BASE)
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert min(seen[k] for k in BASE) > 50


def found(spark, text):
    (row,) = pii.personal_data(spark.createDataFrame([(text,)], "text string")).collect()
    return [(s.kind, text[s.start : s.end], s.score) for s in row.pii]


def test_checks_and_words_nearby(spark):
    iban = "GB82 WEST 1234 5698 7654 32"
    assert found(spark, f"send to {iban}.") == [("iban", iban, 0.9)]
    assert found(spark, f"bank account {iban}, please") == [("iban", iban, 1.0)]
    assert found(spark, "DE89370400440532013000") == [("iban", "DE89370400440532013000", 0.9)]
    assert found(spark, "send to GB82 WEST 1234 5698 7654 33.") == []
    assert found(spark, "number 123-45-6789") == [] == found(spark, "SSN 000-45-6789")
    assert found(spark, "her SSN 123-45-6789") == [("ssn", "123-45-6789", 0.6)]
    assert found(spark, "order no, SSN 123-45-6789") == []
    assert found(spark, "call 234.555.1234 now") == [("phone", "234.555.1234", 0.6)] and found(spark, "no 234.555.1234") == []
    assert [k for k, *_ in found(spark, "release 10.1.2.3")] == ["ip"]  # base spans stay, with a lower score


def test_numbers_that_blanks_join(spark):
    """The base rule loses two cards in a row and a phone number before a card; the method finds them all."""
    text = "x 7536784127813050 4845168114407329 y +1 (269) 555-3296 4524132264652876"
    assert brute_spans(text) == []
    assert [(k, x) for k, x, _ in found(spark, text)] == [("card", "7536784127813050"), ("card", "4845168114407329"), ("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    assert [k for k, *_ in found(spark, CARD)] == ["card"]


def test_personal_data_keeps_other_columns(spark, docs):
    got = pii.personal_data(docs)
    assert got.columns == [*docs.columns, "pii_"] and got.count() == len(ROWS)
    key = lambda r: str(r)
    assert sorted(map(tuple, got.drop("pii_").collect()), key=key) == sorted(map(tuple, docs.collect()), key=key)
    for r in got.collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.pii_ if s.base] == brute_spans(r.text)
    assert pii.personal_data(docs.limit(0)).count() == 0
    assert got.where(F.size("pii_") > 0).count() == 1


@pytest.mark.parametrize("size", [1.0, 1e4, 1e6, 1e8, 1e17, 1e150, 1e300])
def test_search_of_vectors_of_any_size(spark, size):
    """Against Python's integers: sums beyond 2 ** 53, scores beyond a long (the nearest long), ties, one dwarf and giant."""
    rng = np.random.default_rng(int(np.log10(size)) + 1)
    vs = (rng.normal(size=(130, 5)) * size).tolist()
    vs[3], vs[60], vs[61] = vs[50], [256.0] * 5, [-x for x in vs[50]]
    vs[100] = [1.0, -2.0, 0.5]
    rows = [(i, v) for i, v in enumerate(vs)] + [(50, vs[50]), (None, vs[2]), (150, [1.7e308] * 5), (200, [])]
    whole = [[math.floor(256.0 * x) for x in v] for _, v in rows if not any(math.isinf(256.0 * x) for x in v)]
    ids = [i for i, v in rows if not any(math.isinf(256.0 * x) for x in v)]
    want = collections.Counter()
    for n, (i, a) in enumerate(zip(ids, whole, strict=True)):
        if i is not None and i % 50 == 0:
            score = lambda b, a=a: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False))))
            best = sorted((-score(b), (1 << 63) - 1 if j is None else j) for m, (j, b) in enumerate(zip(ids, whole, strict=True)) if m != n)[:5]
            want.update((i, k, None if j == (1 << 63) - 1 else j, -s) for k, (s, j) in enumerate(best, 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert collections.Counter(map(tuple, search.top_k(df).collect())) == want


@pytest.mark.parametrize("weight", [0.1, 0.5, 1.0, 3.0])
def test_slices_of_the_mix_are_even(spark, weight):
    """No slice holds over 2 % of a source, whatever the weight of its documents, and slices stand in order of the keys."""
    keys = spark.range(50_000).select(mixing.sampling_key(F.col("id"), F.lit(weight)).alias("key"))
    sliced = keys.groupBy(mixing.key_slice(F.col("key")).alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    rows = sliced.orderBy("slice").collect()
    assert max(r.n for r in rows) < 0.02 * 50_000 and all(a.high < b.low for a, b in itertools.pairwise(rows))


def test_hashes_of_words_without_objects(monkeypatch):
    """As many hashes as ``split`` finds words, equal for equal words and different for others: texts handled together and
    alone, words longer than a step, empty texts, zero bytes, white space of all kinds."""
    rng = random.Random(6)
    word = lambda: bytes(rng.choice(b"ab\x00\xc3\xa9\x1f!") for _ in range(rng.randint(1, 4)))
    texts = [b"", b" ", b"a", b"\x0b\x0ca\t\r\n", b"x" * 70_000 + b" y " + b"x" * 70_000, b"q" * 300_000 + b" a", b"w " * 70_000, "é\u2003ß".encode()]
    texts += [rng.choice([b" ", b"\n", b"  "]).join(word() for _ in range(60)) for _ in range(60)]
    for together in (1 << 20, 100):
        monkeypatch.setattr(substrings, "TOGETHER", together)
        known = {}
        for t, h in zip(texts, substrings.text_hashes(texts), strict=True):
            assert len(h) == len(t.split())
            assert all(known.setdefault(w, x) == x for w, x in zip(t.split(), h.tolist(), strict=True))
        assert len(set(known.values())) == len(known) > 100
    x = np.random.default_rng(1).integers(0, 1 << 63, 50, np.uint64)
    for width in range(1, 12):
        assert (substrings.least_of(x, width) == np.lib.stride_tricks.sliding_window_view(x, width).min(axis=1)).all()
