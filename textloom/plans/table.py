"""Queries as a table: batches of any size, parsed by tasks and joined with the postings; nothing of a batch passes through the driver or a plan.

Each query becomes rows (qid, slot, term, share, bit). Their terms meet df, and the rows meet the postings of their terms: by broadcast if they are few, else by
an exchange in which a term's postings are dealt out by SALTS ranges of doc_id, as the rows are repeated for, so that no hot term meets in one task.
Boolean queries are decided by document: in disjunctive form by bits, and as a program over the words found if that form is too large.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import wildcard
from textloom.operators.index import Index, document_frequency
from textloom.plans import qlang, shards
from textloom.plans.search import near, ranked
from textloom.shared import BROADCAST_ROWS, ship_package, small_side, staged

SALTS = 16
PARSED = (
    "qid long, query string, qtype string, terms array<struct<slot: int, off: int, term: string, share: double, bit: bigint>>, "
    "size int, products array<bigint>, program array<int>, grams array<array<string>>, patterns array<string>"
)
AND, OR, NEVER = -1, -2, -3


def _program(tree: tuple, slot: dict[str, int]) -> list[int]:
    """The tree in the order in which a stack evaluates it."""
    if tree[0] == "w":
        return [slot[tree[1]]] if tree[1] else [NEVER]
    return [*_program(tree[1], slot), *_program(tree[2], slot), AND if tree[0] == "and" else OR]


def parse_one(query: str, stopwords, stem: bool) -> tuple:
    """qtype and what follows it in PARSED."""
    q = qlang.parse(query, stopwords, stem)
    terms, products, program = [], [0], None
    if q.kind == qlang.BOOLEAN and q.words:
        slot = {w: k for k, w in enumerate(sorted(set(q.words)))}
        found = qlang.products(q.tree)
        if found is None:
            products, program = None, _program(q.tree, slot)
        else:
            products = [sum(1 << slot[w] for w in p) for p in found]
        terms = [(slot[w], 0, w, share, 1 << slot[w] if slot[w] < 63 else 0) for w, share in q.weights.items()]
    elif q.kind in (qlang.PHRASE, qlang.WILDCARD_PHRASE):
        offset, left = 0, dict(q.weights)
        for k, w in enumerate(q.words):
            offset += len(w) + 2 if k else 0
            terms.append((k, offset, w, left.pop(w, 0.0), 0))  # a word that comes again counts once
    elif q.kind == qlang.WILDCARD:
        terms = [(0, 0, q.words[0], 1.0, 0)] if q.words else []
    else:
        terms = [(0, 0, w, share, 0) for w, share in q.weights.items()]
    kind = qlang.WILDCARD if q.kind == qlang.WILDCARD_PHRASE and len(q.words) == 1 else q.kind
    if kind == qlang.WILDCARD:
        terms = [(0, 0, t[2], 1.0, 0) for t in terms]
    stars = [t[2] for t in terms if "*" in t[2]]
    names = ("slot", "off", "term", "share", "bit")
    return q.kind, [dict(zip(names, t, strict=True)) for t in terms], len(q.words), products, program, [sorted(wildcard.grams_of(p)) for p in stars], [wildcard.to_regex(p) for p in stars]


def parse(queries: DataFrame, stopwords=(), stem: bool = False) -> DataFrame:
    """queries: qid, query. One row for each."""
    stop = tuple(stopwords)
    ship_package(queries.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(i, text or "", *parse_one(text or "", stop, stem)) for i, text in zip(batch["qid"], batch["query"], strict=True)]
            yield pd.DataFrame(rows, columns=["qid", "query", "qtype", "terms", "size", "products", "program", "grams", "patterns"])

    return queries.select(F.col("qid").cast("long").alias("qid"), "query").mapInPandas(run, PARSED)


def _expanded(index: Index, words: DataFrame, parsed: DataFrame) -> DataFrame:
    """words, of which those with stars have become rows of the terms that fit, by the grams of the vocabulary. A pattern without any letter fits all terms.

    Only the terms with a pattern's rarest gram are compared with it: each that fits has all of its grams, so none is lost.
    """
    stars = words.where("term like '%*%'")
    asked = parsed.where(F.size("patterns") > 0).select(F.explode(F.arrays_zip("grams", "patterns", F.filter("terms", lambda t: t["term"].contains("*"))["term"].alias("words"))).alias("x"))
    asked = asked.select("x.words", "x.patterns", "x.grams").distinct().toDF("pattern", "rx", "grams")
    vocabulary = index.vocabulary()
    grams = wildcard.begun(wildcard.starts(vocabulary) if index.grams is None else index.grams)
    keys = asked.where(F.size("grams") > 0).select("pattern", "rx", F.explode("grams").alias("gram"))
    often = staged(grams.join(small_side(keys.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often")), "often")
    rarest = keys.join(small_side(often), "gram", "left").groupBy("pattern", "rx").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))["gram"].alias("gram"))
    rarest = staged(rarest, "rarest")
    fit = grams.join(small_side(rarest), "gram").where(F.expr("term rlike rx")).select("pattern", "term").distinct()
    free = asked.where(F.size("grams") == 0).select("pattern", F.lit("").alias("_k"))
    fit = fit.unionByName(vocabulary.withColumn("_k", F.lit("")).join(F.broadcast(free), "_k").select("pattern", "term"))  # a stated query set against all terms
    fit = staged(fit, "fit")
    stars = stars.withColumnRenamed("term", "pattern").join(fit, "pattern").drop("pattern")
    return words.where("term not like '%*%'").unionByName(stars.select(*words.columns))


def _known(index: Index, terms: DataFrame) -> DataFrame:
    """term, df of those of terms that the index has."""
    df = index.terms if index.terms is not None else document_frequency(index.postings.join(small_side(terms), "term", "left_semi"))
    return df.join(small_side(terms), "term", "left_semi")


def _matched(index: Index, words: DataFrame) -> DataFrame:
    """words with doc_id, positions and tfidf of each posting of their term."""
    terms = words.select("term").distinct()
    words = staged(words.join(_known(index, terms), "term"), "words")
    p = index.postings.select("term", "doc_id", "positions", "tf", F.col(index.size).alias("_size"))
    if words.count() <= BROADCAST_ROWS:
        rows = p.join(F.broadcast(words), "term")
    else:
        salted = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = p.join(F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms.hint("merge"), "term", "left_semi")
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["term", "_salt"])
    return rows.withColumn("tfidf", F.col("tf") / F.col("_size") * F.log(F.lit(float(max(1, index.n_docs))) / F.col("df")))


def _holds(found: Column, program: Column) -> Column:
    """Whether the program, run over the slots found, ends in true."""
    last, before = lambda s: F.element_at(s, -1), lambda s: F.element_at(s, -2)

    def step(s: Column, x: Column) -> Column:
        rest = F.slice(s, 1, F.greatest(F.size(s) - 2, F.lit(0)))
        push = F.concat(s, F.array(F.array_contains(found, x)))
        both = F.when(x == AND, before(s) & last(s)).otherwise(before(s) | last(s))
        return F.when(x == NEVER, F.concat(s, F.array(F.lit(False)))).when(x >= 0, push).otherwise(F.concat(rest, F.array(both)))

    return last(F.aggregate(program, F.array().cast("array<boolean>"), step))


def _phrases(matched: DataFrame, parsed: DataFrame, strict: bool) -> DataFrame:
    rows = matched.groupBy("qid", "doc_id").agg(F.sum(F.col("share") * F.col("tfidf")).alias("score"), F.array_sort(F.collect_list(F.struct("slot", "off", "positions"))).alias("slots"))
    rows = rows.join(small_side(parsed.select("qid", F.col("size").alias("n"))), "qid").where(F.size("slots") == F.col("n"))
    first, later = F.element_at("slots", 1)["positions"], F.slice("slots", 2, F.greatest(F.lit(0), F.size("slots") - 1))
    test = lambda s: near(first, s["positions"], s["off"])
    return rows.where((F.col("n") == 1) | (F.forall(later, test) if strict else F.exists(later, test))).select("qid", "doc_id", "score")


def _wildcard_phrases(matched: DataFrame, parsed: DataFrame, strict: bool) -> DataFrame:
    """As search.wildcard_phrase_scores: the largest weight of a first word from which a later one (strict: each) is near, at any sum of the lengths of the slots up to it."""
    one = F.struct(F.length("term").alias("len"), "positions", "tfidf")
    rows = matched.groupBy("qid", "doc_id", "slot").agg(F.collect_list(one).alias("es")).groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("slot", "es"))).alias("slots"))
    rows = rows.join(small_side(parsed.select("qid", F.col("size").alias("n"))), "qid").where(F.size("slots") == F.col("n"))
    rows = rows.select("qid", "doc_id", "slots", F.explode(F.element_at("slots", 1)["es"]).alias("e"))
    start = F.struct(F.array(F.lit(0)).alias("bases"), F.lit(strict).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        close = F.exists(s["es"], lambda e: F.exists(acc["bases"], lambda b: near(F.col("e.positions"), e["positions"], b + e["len"] + 2)))
        bases = F.array_distinct(F.flatten(F.transform(acc["bases"], lambda b: F.transform(s["es"], lambda e: b + e["len"] + 2))))
        return F.struct(bases.alias("bases"), ((acc["ok"] & close) if strict else (acc["ok"] | close)).alias("ok"))

    rows = rows.where(F.aggregate(F.slice("slots", 2, F.size("slots") - 1), start, step, lambda a: a["ok"]))
    return rows.groupBy("qid", "doc_id").agg(F.max("e.tfidf").alias("score"))


def search_table(index: Index, queries: DataFrame, stopwords=(), strict: bool = False, k: int | None = None) -> DataFrame:
    """qid, query, qtype, rank, doc_id, score of all matches (k: of the best k) of queries (qid, query), by score, then doc_id.

    A qid is one query; null queries are empty and match nothing. Wildcards stand for terms of the index itself. A text that many ask is one query until its results are given out;
    of words and boolean queries, k results are found by shards of the documents (plans/shards.py).
    """
    asked = staged(queries.select(F.col("qid").cast("long").alias("qid"), F.coalesce("query", F.lit("")).alias("query")), "asked")
    once = asked.groupBy("query").agg(F.min("qid").alias("qid"))
    parsed = staged(parse(once, stopwords, index.stemmed), "queries")
    words = parsed.select("qid", "qtype", "size", F.col("program").isNotNull().alias("large"), F.explode("terms").alias("t")).select("qid", "qtype", "size", "large", "t.*")
    kinds = {r[0] for r in parsed.select("qtype").distinct().collect()}  # six at most
    starred = bool(kinds & {qlang.WILDCARD, qlang.WILDCARD_PHRASE})
    parts = []
    if k is not None and kinds & {qlang.ONE_WORD, qlang.FREE, qlang.BOOLEAN} and index.postings.schema["doc_id"].dataType.simpleString() in shards.IDS:
        exact = F.col("qtype").isin(qlang.ONE_WORD, qlang.FREE, qlang.BOOLEAN) & ~F.col("large")
        some = words.where(exact)
        terms = staged(_known(index, some.select("term").distinct()).withColumn("code", F.monotonically_increasing_id()), "terms")
        if (terms.agg(F.max("df")).first()[0] or 0) <= index.n_docs:  # no weight is below 0
            wanted = parsed.where(F.col("qtype").isin(qlang.ONE_WORD, qlang.FREE, qlang.BOOLEAN) & F.col("products").isNotNull()).select("qid", "products")
            parts.append(shards.best(index, some.select("qid", "term", "share", "bit"), terms, wanted, k))
            words = words.where(~exact)
    matched = _matched(index, _expanded(index, words, parsed) if starred else words)
    phrase, loose = F.col("qtype") == qlang.PHRASE, (F.col("qtype") == qlang.WILDCARD_PHRASE) & (F.col("size") > 1)
    plain = matched.where(~phrase & ~loose & ~F.col("large")).groupBy("qid", "doc_id").agg(F.sum(F.col("share") * F.col("tfidf")).alias("score"), F.bit_or("bit").alias("bits"))
    wanted = parsed.where("products is not null").select("qid", "products")
    parts.append(plain.join(small_side(wanted), "qid").where(F.exists("products", lambda p: F.col("bits").bitwiseAND(p) == p)).select("qid", "doc_id", "score"))
    programs = parsed.where("program is not null").select("qid", "program")
    if qlang.BOOLEAN in kinds and not programs.isEmpty():
        large = matched.where("large").groupBy("qid", "doc_id").agg(F.sum(F.col("share") * F.col("tfidf")).alias("score"), F.collect_set("slot").alias("found"))
        parts.append(large.join(small_side(programs), "qid").where(_holds(F.col("found"), F.col("program"))).select("qid", "doc_id", "score"))
    if qlang.PHRASE in kinds:
        parts.append(_phrases(matched.where(phrase), parsed, strict))
    if qlang.WILDCARD_PHRASE in kinds:
        parts.append(_wildcard_phrases(matched.where(loose), parsed, strict))
    found = reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 6))
    found = ranked(found, k).join(small_side(parsed.select("qid", "query", "qtype")), "qid").drop("qid")
    return found.join(small_side(asked), "query").select("qid", "query", "qtype", "rank", "doc_id", "score")
