"""Quality rules as a short-circuit cascade, in native DataFrame functions only.

Each rule is a statistic of the text and a rejecting condition on it.  Costs and rejection shares of the rules are
estimated on a random sample of whole texts; the cascade then asks the rule with the most rejection per cost first, and
a text that a rule rejects is asked no further (``CASE WHEN`` stops at its first true branch, and a statistic is computed
where a rule names it).  The order changes the work, never the verdict: a text is kept if no rule rejects it.

Defined results: a null text is an empty text (no words, rejected by ``few_words``); repeated rows are judged alike;
an empty table gives an empty result; other columns pass through untouched, and if one has the name of the new column,
the new one gets underscores behind its name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import discard, let, stored, table, unused, words

#: Rows of the random sample for costs and rejection shares, and how often each is evaluated.
SAMPLE_ROWS, SAMPLE_REPEATS = 128, 16


def n_symbols(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _doubled(a: Column, step: int) -> Column:
    """Hashes of runs of 2 x step words from hashes of runs of step words."""
    size = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, size), F.slice(a, step + 1, size), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows (given by hashes in order of their starts) that occur twice or more."""
    keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        again = F.filter(s, lambda p, j: F.coalesce(p.h == F.get(s, j - 1).h, F.lit(False)) | F.coalesce(p.h == F.get(s, j + 1).h, F.lit(False)))
        return F.sort_array(F.transform(again, lambda p: p.i))

    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc.covered + i + width - F.greatest(acc.end, i)).alias("covered"), (i + width).alias("end"))
    return F.aggregate(let(keyed, starts), zero, step, lambda acc: acc.covered)


def n_repeat_words(found: Column) -> Column:
    """Words in 8-word windows found twice or more in the text.  Linear but for the few texts that do repeat."""
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h, 8))
    eight = lambda a: let(_doubled(a, 1), lambda b: let(_doubled(b, 2), lambda c: let(_doubled(c, 4), count)))
    return let(hashed, eight).cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``bad`` of its statistics is true; ``bad`` gets a function from statistic name to column."""

    name: str
    bad: Callable[[Callable[[str], Column]], Column]


#: Statistics of a text, given the text and its words.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, found: F.size(found).cast("long"),
    "word_chars": lambda text, found: F.length(F.array_join(found, "")).cast("long"),
    "n_symbols": lambda text, found: n_symbols(text),
    "n_dup_lines": lambda text, found: n_dup_lines(text),
    "n_repeat_words": lambda text, found: n_repeat_words(found),
    "n_lines": lambda text, found: F.size(lines(text)).cast("long"),
    "letter_words": lambda text, found: F.size(F.filter(found, lambda w: w.rlike(r"\p{L}"))).cast("long"),
    "different_words": lambda text, found: F.size(F.array_distinct(found)).cast("long"),
    "cut_lines": lambda text, found: F.size(F.filter(lines(text), lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"))).cast("long"),
}
#: Those that the base scan returns; the others are computed only where the cascade asks for them.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The two base rules, then the method's own: symbols, repeated lines, absurd word lengths, words without letters, few
#: different words for the length (root type-token ratio under 3), and lines that break off.
RULES = (
    Rule("few_words", lambda s: s("n_words") < 20),
    Rule("repeated_words", lambda s: 100 * s("n_repeat_words") > 30 * s("n_words")),
    Rule("symbols", lambda s: 100 * s("n_symbols") > 10 * s("word_chars")),
    Rule("repeated_lines", lambda s: (100 * s("n_dup_lines") > 30 * s("n_lines")) & (s("n_lines") >= 4)),
    Rule("word_length", lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 25 * s("n_words"))),
    Rule("few_letters", lambda s: 100 * s("letter_words") < 60 * s("n_words")),
    Rule("few_different_words", lambda s: (s("n_words") >= 100) & (s("different_words") * s("different_words") < 9 * s("n_words"))),
    Rule("cut_lines", lambda s: (s("n_lines") >= 4) & (100 * s("cut_lines") > 60 * s("n_lines"))),
)


def random_sample(docs: DataFrame, rows: int, text: str = "text") -> DataFrame:
    """About ``rows`` random rows' whole texts (at most twice as many; all of a smaller table), stored."""
    share = min(1.0, 1.5 * rows / max(docs.count(), 1))
    return stored(docs.select(F.col(text).alias("text")).sample(fraction=share, seed=7).limit(2 * rows), "quality-sample")


def estimates(docs: DataFrame, rules=RULES, text: str = "text", computed=()) -> dict[str, tuple[float, float]]:
    """Seconds and rejected share of each rule on the sample (for the order only).  Statistics in ``computed`` are there
    anyway, so they cost a rule nothing."""
    found = random_sample(docs, SAMPLE_ROWS, text)
    turns = found.select("text", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_REPEATS))).alias("turn"))
    turned = turns.select(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.col("turn").cast("string")).alias("text"), words(F.col("text")).alias("found"))
    whole = stored(turned.select("*", *(STATISTICS[c](F.col("text"), F.col("found")).alias(f"known_{c}") for c in computed)), "quality-turns")

    def timed(bad: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = whole.agg(F.avg(bad.cast("double"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    idle, _ = timed((F.length("text") < 0) & (F.size("found") < 0))
    of = lambda name: F.col(f"known_{name}") if name in computed else STATISTICS[name](F.col("text"), F.col("found"))
    out = {}
    for rule in rules:
        seconds, share = timed(rule.bad(of))
        out[rule.name] = (max(seconds - idle, 1e-3), share)
    discard(found, whole)
    return out


def ordered(docs: DataFrame, rules=RULES, text: str = "text", computed=()) -> list[Rule]:
    """Rules by rejection per cost, the best first."""
    known = estimates(docs, rules, text, computed)
    return sorted(rules, key=lambda r: (-known[r.name][1] / known[r.name][0], r.name))


def first_failed(rules: list[Rule], statistic: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects; null for a text that all rules keep."""
    out = None
    for rule in rules:
        bad = F.coalesce(rule.bad(statistic), F.lit(False))
        out = F.when(bad, rule.name) if out is None else out.when(bad, rule.name)
    return out if out is not None else F.lit(None).cast("string")


def quality_cascade(docs: DataFrame, rules=RULES, text: str = "text", into: str = "failed_rule") -> DataFrame:
    """Add the first failing rule; statistics are computed only as far as the cascade asks for them, the words once."""
    order = ordered(docs, rules, text)
    verdict = let(words(F.col(text)), lambda found: first_failed(order, lambda name: STATISTICS[name](F.col(text), found)))
    return docs.withColumn(unused(docs, into), verdict)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of every document, and the cascade's verdict on them and, where it goes on, on its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = [r for r in RULES if r.name not in ("few_words", "repeated_words")]
    order = ordered(docs, own, computed=BASE)
    base = lambda s: (s.n_words < 20) | (100 * s.n_repeat_words > 30 * s.n_words)

    def judged(found: Column) -> Column:
        known = F.struct(*(STATISTICS[name](F.col("text"), found).alias(name) for name in BASE))
        of = lambda s: lambda name: s[name] if name in BASE else STATISTICS[name](F.col("text"), found)
        # A text that the base rules reject is asked nothing more.
        return let(known, lambda s: F.struct(s.alias("s"), base(s).alias("base_failed"), F.when(base(s), False).otherwise(first_failed(order, of(s)).isNull()).alias("kept")))

    full = docs.select("doc_id", let(words(F.col("text")), judged).alias("j"))
    return full.select("doc_id", *(F.col(f"j.s.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "j.base_failed", "j.kept")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT rid, win FROM g GROUP BY rid, win HAVING count(*) > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM (SELECT rid, i, unnest(range(0, 8)) AS o FROM g JOIN r USING (rid, win)) GROUP BY rid),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, len(list_distinct(ws)) AS different_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS letter_words,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS cut_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars
            OR (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * letter_words < 60 * n_words
            OR (n_words >= 100 AND different_words * different_words < 9 * n_words) OR (n_lines >= 4 AND 100 * cut_lines > 60 * n_lines)) AS kept
FROM s
"""
