"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed base rules fail short and repetitive texts. Beyond them, each rule compares one ratio with a cutoff
of its stratum (a band of lengths). A cutoff is taken from labelled holdout documents: among the grid of
candidates, only those count whose false rejection of good documents is at most ALPHA / 3, an equal part for each of the three
rules, with certainty 1 - DELTA by the exact binomial bound, DELTA being divided by the number of all tests
(Bonferroni); so all rules of a stratum together reject at most ALPHA of its good documents. Of those, the one that rejects most bad documents in excess of good ones is used, the most
lenient on ties; a rule without any such cutoff rejects nothing in that stratum.

Defined cases: null text has no words and fails the base rules; labels that are null or repeat count as
they stand; without labels only the base rules hold; every input row gives one row; null doc_id has no label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import staged

#: At most this share of the good documents of a stratum may be rejected by its rules together, but for the chance DELTA over all tests.
ALPHA, DELTA = 0.02, 0.05
#: Upper ends of the strata in words; the last is open.
BANDS = (200, 1_000, 5_000)
#: Candidate cutoffs of each ratio, in ten-thousandths, from strict to lenient: a document is rejected above it.
GRID = (50, 100, 200, 300, 500, 700, 1_000, 1_500, 2_000, 3_000, 4_000, 5_000, 7_000)
RULES = ("symbol_ratio", "repeat_ratio", "dup_line_ratio")
SPACES = r"[ \t-\r]+"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows sorted by hash, neighbours compared, covered words counted."""
    size = F.greatest(n - 2, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def repeated(w: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(w, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(w, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = lambda at: F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(placed(h), lambda w: covered(repeated(w)))).otherwise(0))
    return F.when(size > 1, count).otherwise(0)


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the counts of the contract, and those that the ratios need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda letters: F.length(F.regexp_replace("t", f"[^{letters}]+", ""))
    d = docs.select("doc_id", *keep, text.alias("t"))
    d = d.select("doc_id", *keep, "t", F.array_remove(F.split("t", SPACES), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"))
    d = d.select("doc_id", *keep, F.size("w").alias("n"), "w", F.length(F.array_join("w", "")).alias("word_chars"), only("#*$%&|<>").alias("n_symbols"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return d.select("doc_id", *keep, F.col("n").cast("long").alias("n_words"), *long("word_chars", "n_symbols", "n_dup_lines"), _repeat_words(F.col("w"), F.col("n")).cast("long").alias("n_repeat_words"), *long("n_lines"))


def _base(f: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 10_000 / F.col(b)).otherwise(0.0)
    ratios = [share(a, b).alias(r) for r, (a, b) in zip(RULES, (("n_symbols", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines")), strict=True)]
    band = sum(((F.col("n_words") >= x).cast("int") for x in BANDS), F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return f.select("*", failed.alias("base_failed"), band.alias("band"), *ratios)


def _lgamma(x: Column) -> Column:
    """ln of the gamma function of x >= 1, by Stirling's series ten places further up."""
    y = x + 10.0
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - sum((F.log(x + float(i)) for i in range(1, 10)), F.log(x))


def tail_log(n: Column, k: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k) for k below the mean, from the largest term downwards as far as terms count in doubles: some standard deviations."""
    n, k = n.cast("double"), k.cast("double")
    top = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a: Column, j: Column) -> Column:  # from k - j to k - j - 1
        i = k - j
        term = F.when(i > 0, a["term"] * i / (n - i + 1.0) * ((1 - p) / p)).otherwise(0.0)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    steps = F.least(k, 100 + 40 * F.sqrt(k)).cast("long")
    return top + F.log(F.aggregate(F.sequence(F.lit(0).cast("long"), steps), zero, step)["sum"])


def thresholds(base: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """band, rule, cutoff: what the labelled documents that pass the base rules allow. At most bands x rules rows.

    Each document adds to one count for each rule; no list of documents is built.
    """
    tests, alpha = (len(BANDS) + 1) * len(RULES) * len(GRID), alpha / len(RULES)
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("of"), "quality")
    over = lambda r: sum(((F.col(r) > g).cast("int") for g in GRID), F.lit(0))  # noqa: E731  how many cutoffs reject it
    seen = base.where("not base_failed").join(known, F.col("doc_id") == F.col("of"))
    seen = seen.select("band", "quality", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), over(r).alias("over")) for r in RULES])))
    seen = seen.groupBy("band", "rule", "over").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    # bands x rules x cutoffs rows at most from here on: sums over the documents that each cutoff rejects
    cells = seen.select("band", "rule", F.inline(F.transform(F.array(*map(F.lit, GRID)), lambda g, i: F.struct(g.alias("cutoff"), F.when(F.col("over") > i, F.col("good")).otherwise(0).alias("good"), F.when(F.col("over") > i, F.col("bad")).otherwise(0).alias("bad"), F.col("good").alias("all_good"), F.col("bad").alias("all_bad")))))
    cells = cells.groupBy("band", "rule", "cutoff").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("all_good").alias("n1"), F.sum("all_bad").alias("n0"))
    # Only counts below the mean can pass.
    safe = (F.col("good") < alpha * F.col("n1")) & (tail_log(F.col("n1"), F.when(F.col("good") < alpha * F.col("n1"), F.col("good")).otherwise(0), alpha) <= F.log(F.lit(delta / tests)))
    gain = F.col("bad") / F.greatest(F.col("n0"), F.lit(1)) - F.col("good") / F.greatest(F.col("n1"), F.lit(1))
    best = cells.where(safe & (gain > 0)).groupBy("band", "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff")).alias("best"))
    return best.select("band", "rule", F.col("best.cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, *keep: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The counts of each row of docs, base_failed, kept, and the columns keep of docs."""
    base = _base(staged(features(docs, *keep), "features"))
    limits = thresholds(base, labels, alpha, delta).groupBy("band").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    limits = limits.select(F.col("band").alias("of_band"), *[F.col(r).alias(f"max_{r}") for r in RULES])
    d = base.join(F.broadcast(limits), F.col("band") == F.col("of_band"), "left")  # one row for each band
    passed = F.lit(True)
    for r in RULES:
        passed &= F.coalesce(F.col(r) <= F.col(f"max_{r}"), F.lit(True))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passed).alias("kept"), *keep)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    marked = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return judge(marked, labels, "_row").where("kept").select("_row.*")
