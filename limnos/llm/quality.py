"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule compares ``100 * numerator`` with ``limit * denominator`` in whole numbers, so no rule
depends on rounding. The whole text of every row is measured in place: no shuffle, no user function,
and memory bounded by one text.

Defined cases: a null or blank text has zero words and fails the base rule; a null doc_id passes through;
equal rows are each judged alone; an empty table gives an empty result; columns of the input that carry the name of
a measure are left untouched by ``keep_good`` and are not returned by ``quality_rules`` beyond the id.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

# Frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from had has have in is it not of on or that the this to was were which with you "
    "als auf das dem den der des die ein eine er es für ich im ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al con del el los las lo más no o para por se su una y"
).split()

WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
SYMBOLS = r"[#*$%&|<>]"


class Rule(NamedTuple):
    """Rejects when 100 * numerator is above (or below) limit * denominator."""

    name: str
    numerator: str
    denominator: str
    keep: str  # "at most" or "at least"
    limit: int


RULES = (
    Rule("mean word length", "word_chars", "n_words", "at most", 1500),
    Rule("mean word length", "word_chars", "n_words", "at least", 200),
    Rule("symbols per word", "n_symbols", "n_words", "at most", 20),
    Rule("stop words", "n_stop_words", "n_words", "at least", 5),
    Rule("shouted words", "n_shouted", "n_words", "at most", 40),
    Rule("repeated lines", "n_dup_lines", "n_lines", "at most", 50),
    Rule("stuttered words", "n_stutters", "n_words", "at most", 40),
    Rule("repeated windows", "n_repeat_words", "n_words", "at most", REPEAT_PERCENT),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more in the array.

    Windows are compared by a 64-bit hash of their words plus a 32-bit one of another kind; only texts in
    which some hash recurs reach the sort, so usual texts cost one pass.
    """
    n = F.size(words)

    def windows(w):
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(window))))

    def covered(w, hashes):
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.hash(F.slice(w, i + 1, F.lit(window))).alias("g"), i.alias("i"))))

        def found(s):
            same = lambda x, y: (x.h == y.h) & (x.g == y.g)
            last = F.size(s) - 1
            again = F.filter(s, lambda e, k: ((k > 0) & same(F.get(s, F.greatest(k - 1, F.lit(0))), e)) | ((k < last) & same(F.get(s, F.least(k + 1, last)), e)))
            return F.array_sort(F.transform(again, lambda e: e.i))

        def spread(p):
            return F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1), x + window) - x)), F.lit(0).cast("int"), lambda a, x: a + x
            )

        return _let(_let(keyed, found), spread)

    def measure(w):
        return _let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(w, h)))

    return F.when(n <= window, F.lit(0)).otherwise(_let(words, measure)).cast("long")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Name to expression, over a text and its array of words; all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long"),
        "n_stutters": F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).cast("long"),
        "n_shouted": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*!!(?![^\x20\x09-\x0D])")).cast("long"),
    }


def verdict(of, rules=RULES) -> Column:
    """True where no rule of the table rejects; of(name) gives a measure."""
    ok = F.lit(True)
    for r in rules:
        left, right = of(r.numerator) * 100, of(r.denominator) * r.limit
        ok = ok & ((left <= right) if r.keep == "at most" else (left >= right))
    return ok


def base_failed(of) -> Column:
    return (of("n_words") < MIN_WORDS) | (of("n_repeat_words") * 100 > of("n_words") * REPEAT_PERCENT)


def quality_rules(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, the measures, base_failed and kept.

    The row passes through an explode of one element: a later filter on ``kept`` then stays above it, and is not turned into
    one that measures the text anew for every rule.
    """
    words = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"), words_of(F.col(f"`{text}`")).alias("w"))
    measured = words.select("id", *[v.alias(k) for k, v in measures(F.col("t"), F.col("w")).items()])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_stutters", "n_shouted"]
    failed = base_failed(F.col)
    row = F.struct(F.col("id").alias(doc_id), *names, failed.alias("base_failed"), (~failed & verdict(F.col, rules)).alias("kept"))
    return measured.select(F.explode(F.array(row)).alias("m")).select("m.*")


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that the base rule and the table keep, with their own columns.

    One predicate binds the words and the measures once each; columns would be measured anew for every rule that names
    them once the optimizer has moved the filter below them.
    """
    t = F.col(f"`{text}`")

    def good(m):
        of = lambda k: m[k]
        return ~base_failed(of) & verdict(of, rules)

    measured = lambda w: _let(F.struct(*[v.alias(k) for k, v in measures(t, w).items()]), good)
    return docs.filter(_let(words_of(t), measured))


def oracle() -> str:
    """DuckDB SQL for quality_rules over documents."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    tests = " AND ".join(f"{r.numerator} * 100 {'<=' if r.keep == 'at most' else '>='} {r.denominator} * {r.limit}" for r in RULES)
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         row_number() OVER () AS k
  FROM documents),
lined AS (
  SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM base),
win AS (
  SELECT k, i, list_slice(w, i, i + {WINDOW - 1}) AS g
  FROM base, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
spread AS (
  SELECT k, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM again) GROUP BY k),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS BIGINT) AS n_stutters,
         CAST(len(list_filter(w, lambda x: ends_with(x, '!!'))) AS BIGINT) AS n_shouted
  FROM base JOIN lined USING (k) LEFT JOIN spread USING (k))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND {tests} AS kept
FROM m"""
