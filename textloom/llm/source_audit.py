"""How far the sources of a language differ in their words: a relational audit.

Terms are exploded from the texts and counted by (lang, source, term); terms of few documents go. Each group of a language is crossed with
the kept vocabulary, so that words it lacks count as zero, and the groups of a language are joined with each other term by term.
The sums over terms rank the other sources of each source; the terms in which a source lies above its language are ranked beside them.

Hot terms, sources and languages are counted before they are exchanged, and all later exchanges go by (lang, term). The table of groups, one row for each
(lang, source), is broadcast after it is counted. All arithmetic is in integers; products that a long may not hold are decimals.

Defined cases: null text, lang or source are ''; each row is a document of its own, also where doc_id is null or repeats; a group without kept terms
has rows with value 0 where its language keeps none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import small_side, staged

#: Letters of the ASCII range and all characters beyond it.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENTS, RANKS, SCALE = 3, 200, 1_000_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z; all else stays. lower() says the same of texts in ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with it) of each group and term. groups: lang, source, group, a number that stands for both while terms are counted."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text")).join(small_side(groups), ["lang", "source"])
    rows = rows.select("group", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    once = lambda terms, n, d: F.struct(terms.alias("terms"), F.lit(n).cast("long").alias("n"), F.lit(d).cast("long").alias("d"))
    both = F.explode(F.array(once(F.col("terms"), 1, 0), once(F.array_distinct("terms"), 0, 1)))  # all terms count, distinct ones count documents
    each = rows.select("group", both.alias("x")).select("group", "x.n", "x.d", F.explode("x.terms").alias("term"))
    counted = each.groupBy("group", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return counted.join(small_side(groups), "group").select("lang", "source", "term", "n", "d")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", top, (total + terms).cast("decimal(20,0)"))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank. documents: those of its language that a term must be in; ranks: of part `term`."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = staged(groups.withColumn("group", F.monotonically_increasing_id()), "groups")
    own = Window.partitionBy("lang", "term")  # at most one row for each source
    counted = term_counts(docs, groups).withColumn("in_lang", F.sum("n").over(own)).withColumn("docs", F.sum("d").over(own))
    kept = staged(counted.where(F.col("docs") >= documents).select("lang", "term", "source", "n", "in_lang"), "kept")
    langs = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = staged(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "groups")

    # every group with every kept term of its language
    found = kept.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("found"))
    dense = found.join(small_side(groups), "lang")
    dense = dense.select("lang", "term", "source", share(F.coalesce(F.col("found")[F.col("source")], F.lit(0)), F.col("total"), F.col("terms")).alias("p"))
    one, other = dense.alias("one"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(other, ["lang", "term"]).where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    there = kept.where("n > 0").join(small_side(groups), ["lang", "source"])
    there = there.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    above = there.where("p > q").select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    numbered = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return numbered(pairs).unionByName(numbered(above).where(F.col("rank") <= ranks))


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
