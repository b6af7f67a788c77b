"""Wildcard patterns: * at the end is any suffix; elsewhere it skips up to the first character that follows it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    out, i = "^", 0
    while i < len(pattern):
        c = pattern[i]
        if c != "*":
            out += re.escape(c)
        elif i + 1 == len(pattern):
            out += ".*"
        elif pattern[i + 1] != "*":
            out += f"[^{re.escape(pattern[i + 1])}]*"
        i += 1
    return out + "$"


def literal_prefix(pattern: str) -> str:
    return pattern.split("*", 1)[0]


def matches(term, pattern: str) -> Column:
    """The literal prefix is a condition of its own, so that scans can skip row groups by it."""
    term = F.col(term) if isinstance(term, str) else term
    prefix = literal_prefix(pattern)
    rest = term.rlike(to_regex(pattern))
    return term.startswith(prefix) & rest if prefix else rest


#: Marks at the two ends of a term, which no term contains, and the sizes of grams.
FIRST, LAST, GRAMS = "^", "$", 3


def gram_table(vocabulary: DataFrame) -> DataFrame:
    """gram, term: all runs of 1 to GRAMS characters of each term with its end marks, once each. Sorted by gram, a pattern needs a few row groups of it."""
    marked = F.concat(F.lit(FIRST), "term", F.lit(LAST))

    def runs(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") + (3 - k), F.lit(1))), lambda i: F.substring(marked, i, F.lit(k)))

    each = vocabulary.select("term", F.explode(F.array_distinct(F.concat(*map(runs, range(1, GRAMS + 1))))).alias("gram"))
    return each.where(~F.col("gram").isin("", FIRST, LAST)).select("gram", "term")


def grams_of(pattern: str) -> set[str]:
    """Grams that each term that fits has: of each piece between stars the runs of GRAMS characters, or the piece itself if it is shorter."""
    out = set()
    for piece in re.split(r"\*+", FIRST + pattern + LAST):
        if piece not in ("", FIRST, LAST):
            out |= {piece[i : i + GRAMS] for i in range(max(1, len(piece) - GRAMS + 1))}
    return out


def starts(vocabulary: DataFrame) -> DataFrame:
    """gram, term: of each place of a term with its end marks the GRAMS characters from there on, fewer at its end, once each. All grams of gram_table begin one of these, so
    a third of the rows does for patterns, too."""
    marked = F.concat(F.lit(FIRST), "term", F.lit(LAST))
    each = F.transform(F.sequence(F.lit(1), F.length("term") + 1), lambda i: F.substring(marked, i, F.lit(GRAMS)))
    return vocabulary.select("term", F.explode(F.array_distinct(each)).alias("gram")).select("gram", "term")


def begins(grams: list[str]) -> Column:
    """The rows of starts that one of these grams begins."""
    whole, short = [g for g in grams if len(g) == GRAMS], [g for g in grams if len(g) < GRAMS]
    return reduce(Column.__or__, [F.col("gram").isin(whole)] * bool(whole) + [F.col("gram").startswith(g) for g in short])


def begun(grams: DataFrame) -> DataFrame:
    """gram, term: the grams that begin those of starts; a term may have one more than once."""
    return grams.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(GRAMS)), lambda n: F.substring("gram", F.lit(1), n)))).alias("gram"), "term")
