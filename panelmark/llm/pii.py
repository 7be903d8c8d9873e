"""Personal data: regular expressions propose spans, checks confirm them, words nearby adjust the score.

Native DataFrame functions only.  A *finder* has a pattern, a check of the match (Luhn's sum of a card, the remainder by
97 of an IBAN, ranges of an address's parts) and words that raise or lower its score.  A span is kept if its score
reaches ``THRESHOLD``; the four base kinds reach it by their check alone, a social security number or a phone number
without a country code only beside a word that names it.

Places come from one ``split`` of the text at the pattern: a match starts where the pieces and matches before it end.
Their running sums are made in chunks of ``CHUNK``, so that a text of a million matches is no quadratic work.  The patterns
are those of the contract with possessive repeats, and guards in front that keep a run without a match from being tried
again at each of its characters; neither changes what is found.

Later finders of a kind look for what the base rule loses: a card or phone number that blanks join to the next number.
Such a span is left out where it meets a base span of its kind.

Defined results: a null text is an empty text without spans; repeated rows are judged alike; an empty table gives an
empty result; other columns pass through untouched, and if one has the name of the new column, the new one gets
underscores behind its name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import let, table, unused

#: Kinds in the order of a start's ties.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
THRESHOLD = 0.5
#: Characters of context before and behind a match; neither goes beyond the neighbouring match of the same finder.
BEFORE, BEHIND = 48, 24
CHUNK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _n_digits(x: Column, low: int, high: int) -> Column:
    return F.length(_digits(x)).between(low, high)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: from the right, every other digit counts the digit sum of its double."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int"), lambda v: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))))
    return F.aggregate(each, F.lit(0), lambda total, v: total + v) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether the first four characters, put behind the others, make a number with remainder 1 by 97 (A is 10, Z 35)."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    worth = F.transform(turned, lambda c: F.ascii(c) - F.when(c < "A", 48).otherwise(55))
    return F.aggregate(worth, F.lit(0), lambda rest, v: (rest * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


@dataclass(frozen=True)
class Finder:
    """Matches of ``pattern`` that pass ``check(match, piece behind it)`` are spans of ``kind`` with ``score``, plus 0.3
    beside a word of ``words`` and less 0.2 beside one of ``against``.  ``base``: part of the contract's base."""

    kind: str
    pattern: str
    check: Callable[[Column, Column], Column]
    score: float
    words: str
    against: str = ""
    base: bool = False


_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NO_DIGIT = "^[0-9]"
_CARD = lambda x, _: luhn(_digits(x))
_OTHER = "order|invoice|article|version|serial|isbn|part no"
FINDERS = (
    Finder("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x, _: F.lit(True), 0.9, "mail|contact|write to", base=True),
    Finder("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda x, _: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.7, "ip|address|host|server", "version|release", base=True),
    Finder("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", _CARD, 0.7, "card|visa|credit|payment", _OTHER, base=True),
    Finder("phone", r"\+[0-9](?:[\x20().-]*+[0-9]){9,14}+(?![\x20().-]*+[0-9])", lambda x, _: F.length(x) > 3, 0.8, "phone|tel|call|mobile|fax", base=True),
    Finder("card", r"(?<![0-9])[0-9]{14,19}+(?![0-9])", _CARD, 0.6, "card|visa|credit|payment", "order|invoice|version"),
    Finder("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}", lambda x, behind: _n_digits(x, 10, 15) & ~behind.rlike(_NO_DIGIT), 0.6, "phone|tel|call|mobile|fax"),
    Finder("phone", r"(?<![0-9().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9().-])", lambda x, _: F.lit(True), 0.3, "phone|tel|call|mobile|fax", _OTHER),
    Finder("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", lambda x, _: mod_97(x), 0.9, "iban|account|bank"),
    Finder("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda x, _: ~x.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|tax id", _OTHER),
)
#: What a text has to hold for any finder to look at it.
_WORTH_A_LOOK = "[0-9@]"


def running_sums(lengths: Column) -> Column:
    """Running sums (each with its own element) of an array of whole numbers, in chunks of ``CHUNK``."""
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
    add = lambda acc, v: F.struct((acc.total + v).alias("total"), F.concat(acc.sums, F.array(acc.total + v)).alias("sums"))
    chunk = lambda j: F.aggregate(F.slice(lengths, j * CHUNK + 1, F.lit(CHUNK)), zero, add)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), chunk)

    def joined(parts: Column) -> Column:
        ends = F.aggregate(F.transform(parts, lambda p: p.total), zero, add, lambda acc: acc.sums)
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, j: F.transform(p.sums, lambda v: v + F.when(j > 0, F.get(e, j - 1)).otherwise(0)))))

    return F.when(F.size(lengths) > 0, let(chunks, joined)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, matches: Column, finder: Finder) -> Column:
    """Confirmed spans of a finder: (start, rank, end, kind, score, base), given all matches of its pattern."""
    rank = KINDS.index(finder.kind)

    def located(pieces: Column) -> Column:
        gone = F.transform(matches, lambda x, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))
        return let(running_sums(gone), lambda starts: F.transform(matches, lambda x, i: one(pieces, F.get(starts, i), x, i)))

    def one(pieces: Column, start: Column, x: Column, i: Column) -> Column:
        near = F.lower(F.concat(F.right(F.get(pieces, i), F.lit(BEFORE)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(BEHIND))))
        beside = lambda words: near.rlike(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")
        score = F.lit(finder.score) + F.when(beside(finder.words), 0.3).otherwise(0.0)
        if finder.against:
            score = score - F.when(beside(finder.against), 0.2).otherwise(0.0)
        ok = finder.check(x, F.get(pieces, i + 1))
        return F.when(ok, F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("end"), F.lit(finder.kind).alias("kind"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"), F.lit(finder.base).alias("base")))

    kept = lambda found: F.filter(found, lambda s: s.isNotNull() & (s.base | (s.score >= THRESHOLD)))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>>")
    return F.when(F.size(matches) > 0, kept(let(F.split(text, finder.pattern, -1), located))).otherwise(none)


def _apart(spans: Column) -> Column:
    """Sorted spans of one kind, without added ones that meet the span before or, if that is base, behind them."""

    def stays(s: Column, i: Column) -> Column:
        before, behind = F.get(spans, i - 1), F.get(spans, i + 1)
        meets = F.coalesce((before.end > s.start) & (i > 0), F.lit(False)) | F.coalesce(behind.base & (behind.start < s.end), F.lit(False))
        return s.base | ~meets

    return F.filter(spans, stays)


def personal_data(docs: DataFrame, text: str = "text", into: str = "pii", finders: tuple[Finder, ...] = FINDERS) -> DataFrame:
    """Add the spans of each text: array of (start, rank, end, kind, score, base), by start, then kind.  Starts and ends
    are code points from 0, ends are exclusive."""
    body = unused(docs, "pii_text")
    names = [f"{body}_{i}" for i in range(len(finders))]
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    look = F.when(F.col(body).rlike(_WORTH_A_LOOK), F.col(body))
    none = F.array().cast("array<string>")
    out = out.withColumns({n: F.coalesce(F.regexp_extract_all(look, F.lit(f.pattern), F.lit(0)), none) for n, f in zip(names, finders, strict=True)})
    by_kind = []
    for kind in KINDS:
        own = [spans_of(F.col(body), F.col(n), f) for n, f in zip(names, finders, strict=True) if f.kind == kind]
        if own:
            by_kind.append(own[0] if len(own) == 1 else let(F.sort_array(F.concat(*own)), _apart))
    spans = F.sort_array(F.concat(*by_kind))
    return out.select(*(docs[c] for c in docs.columns), spans.alias(unused(docs, into)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all spans with the method's own."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s.base)
    count = lambda kind: F.size(F.filter("pii", lambda s: s.base & (s.kind == kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), F.array_max(F.transform("pii", lambda s: s.score)).alias("top_score"))
