"""Quality rules: a table of thresholds compiled into one projection.

``measures`` takes a text's counts (words, their characters, symbols, stop
words, lines, repeated lines, words in repeated windows); a ``Rule`` bounds one
count, or its share of another, in hundredths.  The table becomes one array of
the names of broken rules, compared in whole numbers, so nothing is rounded.
All of it is column expressions of a row: no shuffle, no Python.

Two windows are the same when their 64-bit hashes are: in a text of a million
words the chance of a wrong one is 3 in 10^8.

Defined cases: a null text is an empty one, without words, and fails the base
rules; words and lines are those of the whole text, whatever its length; rows
that repeat are judged each; null ids stay null; an empty table gives no rows;
other columns go no further.  A share of nothing breaks no rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that part words, symbols, and the words of a window (a power of two).
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

STOP_WORDS = (
    "a an and are as at be by for from in is it not of on or that the this to was which with "
    "au avec ce dans de des du en est et il la le les ne par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für ist mit nicht sich sie und von zu "
    "al con del el es esta las los más no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``count`` (or its share of ``of``) lies between ``low`` and ``high`` hundredths."""

    name: str
    count: str
    of: str | None = None
    low: int | None = None
    high: int | None = None
    base: bool = False


#: Base rules are fixed; the others reject texts far from any running prose.
RULES = (
    Rule("few_words", "n_words", low=2000, base=True),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=30, base=True),
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=25),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("stop_words", "n_stop", "n_words", low=1),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas of ``use`` read it."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _in_repeats(words: Column) -> Column:
    """How many words lie in windows that occur twice or more."""

    def of_hashes(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"])
        again = _let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"])))
        # a window adds the words by which it starts after the one before, at most all of its own
        new = _let(again, lambda p: F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(at - F.get(p, i - 1), F.lit(WINDOW)))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.aggregate(new, F.lit(0), lambda a, b: a + b))

    # hashes of one word, then of twice as many words again and again
    def doubled(span: int) -> Callable[[Column], Column]:
        return lambda hashes: F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + span)))

    windows, span = F.transform(words, lambda w: F.xxhash64(w)), 1
    while span < WINDOW:
        windows, span = _let(windows, doubled(span)), 2 * span
    return F.when(F.size(words) > WINDOW, _let(F.slice(windows, 1, F.size(words) - (WINDOW - 1)), of_hashes)).otherwise(F.lit(0))


def _forms(stop_words: Iterable[str]) -> list[str]:
    """Each word as it stands, with a first capital, and in capitals."""
    return sorted({form for w in stop_words for form in (w, w.capitalize(), w.upper())})


def measures(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_stop, n_lines, n_dup_lines, n_repeat_words), a row for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    forms = _forms(stop_words)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, BLANKS) != "")
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x: x.isin(*forms))).alias("stop"), _in_repeats(w).alias("again")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("unlike")))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), of_words.alias("w"), of_lines.alias("l"))
    counts = {
        "n_words": F.col("w.n"), "word_chars": F.length(_without(F.col("text"), BLANKS)), "n_symbols": F.length("text") - F.length(_without(F.col("text"), SYMBOLS)), "n_stop": F.col("w.stop"),
        "n_lines": F.col("l.n"), "n_dup_lines": F.col("l.n") - F.col("l.unlike"), "n_repeat_words": F.col("w.again"),
    }
    return counted.select("doc_id", *[c.cast("long").alias(name) for name, c in counts.items()])


def broken(rules: Iterable[Rule]) -> Column:
    """The names of the rules that a row of ``measures`` breaks, in the table's order."""

    def breaks(rule: Rule) -> Column:
        value, whole = F.col(rule.count) * 100, F.col(rule.of) if rule.of else F.lit(1)
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < whole * rule.low)
        if rule.high is not None:
            out = out | (value > whole * rule.high)
        return F.when(out, F.lit(rule.name))

    return F.array_compact(F.array(*[breaks(r) for r in rules])) if rules else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules: Iterable[Rule] = RULES, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """All measures, ``failed`` (names of broken rules), ``base_failed`` and ``kept`` (none is broken)."""
    rules = tuple(rules)
    judged = measures(docs, stop_words).withColumn("failed", broken(rules))
    base = [r.name for r in rules if r.base]
    return judged.withColumn("base_failed", F.arrays_overlap("failed", F.array(*map(F.lit, base))) if base else F.lit(False)).withColumn("kept", F.size("failed") == 0)


def op13_rules(spark, sf_dir: str) -> DataFrame:
    judged = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.withColumn("failed", F.array_join("failed", ","))


def _sql() -> str:
    """The query in SQL: words, lines and windows as lists, windows compared as text."""

    def breaks(rule: Rule) -> str:
        whole = rule.of or "1"
        tests = [f"{rule.count} * 100 < {whole} * {rule.low}"] * (rule.low is not None) + [f"{rule.count} * 100 > {whole} * {rule.high}"] * (rule.high is not None)
        return f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END"

    stop = ", ".join(f"'{w}'" for w in _forms(STOP_WORDS))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda v: regexp_replace(v, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l FROM t),
g AS (SELECT r, unnest([array_to_string(w[i:i + {WINDOW - 1}], ' ') FOR i IN range(1, len(w) - {WINDOW - 2})]) AS g, unnest(range(len(w) - {WINDOW - 1})) AS i FROM w WHERE len(w) > {WINDOW}),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range({WINDOW}) k(k) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(w, lambda v: v IN ({stop})))::BIGINT AS n_stop, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, list_filter([{", ".join(map(breaks, RULES))}], lambda v: v IS NOT NULL) AS f FROM m)
SELECT * EXCLUDE (f), array_to_string(f, ',') AS failed, list_has_any(f, [{", ".join(f"'{r.name}'" for r in RULES if r.base)}]) AS base_failed, len(f) = 0 AS kept FROM f
"""


SQL = _sql()
