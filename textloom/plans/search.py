"""Query batches over an index: ranked results as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import wildcard
from textloom.operators.index import Index
from textloom.operators.numbering import numbered
from textloom.plans import blocks, qlang
from textloom.plans.qlang import Query
from textloom.shared import small_side, staged

PROXIMITY = 5
#: Terms that a wildcard may stand for and still be named in the scan.
PUSHED = 2000


def lookup(index: Index, term: str, positions: bool = False) -> DataFrame:
    return index.of([term]).select("doc_id", *(["positions"] if positions else []))


def boolean_docs(index: Index, query: Query) -> DataFrame:
    """doc_id of the documents for which the tree holds: one grouping by document, whatever the nesting."""
    words = sorted(set(query.words))
    rows = index.of(words).groupBy("doc_id").agg(*[F.max(F.col("term") == w).alias(f"f{i}") for i, w in enumerate(words)])
    at = {w: f"f{i}" for i, w in enumerate(words)}
    return rows.where(qlang.as_sql(query.tree, at.__getitem__)).select("doc_id")


def near(first: Column, later: Column, offset) -> Column:
    """Some position in later lies within PROXIMITY of one in first plus offset. The nearest two are neighbours when all are sorted."""
    marks = F.concat(F.transform(first, lambda p: F.struct((p + offset).cast("int").alias("at"), F.lit(False).alias("later"))), F.transform(later, lambda q: F.struct(q.alias("at"), F.lit(True).alias("later"))))
    far = F.lit(-(1 << 30))
    start = F.struct(far.alias("a"), far.alias("b"), F.lit(False).alias("found"))

    def step(x: Column, m: Column) -> Column:
        other = F.when(m["later"], x["a"]).otherwise(x["b"])
        return F.struct(F.when(m["later"], x["a"]).otherwise(m["at"]).alias("a"), F.when(m["later"], m["at"]).otherwise(x["b"]).alias("b"), (x["found"] | (m["at"] - other <= PROXIMITY)).alias("found"))

    return F.aggregate(F.array_sort(marks), start, step, lambda x: x["found"])


def phrase_batch(index: Index, queries: list[tuple[int, Query]], strict: bool = False) -> DataFrame:
    """qid, doc_id, score of all phrases as one plan: documents with all words, a later one (strict: every later one) near its place behind the first."""
    rows, sizes = [], []
    for i, q in queries:
        offset, left = 0, dict(q.weights)
        for slot, w in enumerate(q.words):
            offset += len(w) + 2 if slot else 0
            rows.append((i, slot, offset, w, left.pop(w, 0.0)))  # a word that comes again counts once
        sizes.append((i, len(q.words)))
    spark = index.postings.sparkSession
    slots = spark.createDataFrame(rows, "qid int, slot int, off int, term string, share double")
    ranges = blocks.needed(index, [(i, dict.fromkeys(q.words, 1.0), [frozenset(q.words)]) for i, q in queries])
    found = index.weights(sorted({r[3] for r in rows}), ranges).join(F.broadcast(slots), "term")  # the parsed queries, which the driver holds
    found = found.groupBy("qid", "doc_id").agg(F.sum(F.col("share") * F.col("tfidf")).alias("score"), F.array_sort(F.collect_list(F.struct("slot", "off", "positions"))).alias("slots"))
    found = found.join(F.broadcast(spark.createDataFrame(sizes, "qid int, size int")), "qid").where(F.size("slots") == F.col("size"))  # one row for each phrase
    first = F.element_at("slots", 1)["positions"]
    test = lambda s: near(first, s["positions"], s["off"])
    later = F.slice("slots", 2, F.greatest(F.lit(0), F.size("slots") - 1))
    found = found.where((F.col("size") == 1) | (F.forall(later, test) if strict else F.exists(later, test)))
    return found.select("qid", "doc_id", "score")


def expansions(index: Index, pattern: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """term: the distinct index terms whose surface form fits. vocabulary: surface (term, stem) of a stemmed index.

    With stored grams, those of the pattern reach the scan, terms that have all of them are left, and these are compared with the pattern.
    """
    if vocabulary is not None:
        return vocabulary.where(wildcard.matches("term", pattern)).select(F.col("stem").alias("term")).distinct()
    asked = sorted(wildcard.grams_of(pattern))
    if index.grams is None or not asked:
        return index.vocabulary().where(wildcard.matches("term", pattern))
    has = index.grams.where(wildcard.begins(asked)).groupBy("term").agg(*[F.max(F.col("gram").startswith(g)).alias(f"g{i}") for i, g in enumerate(asked)])
    return has.where(reduce(Column.__and__, [F.col(f"g{i}") for i in range(len(asked))]) & wildcard.matches("term", pattern)).select("term")


def expanded(index: Index, pattern: str, vocabulary: DataFrame | None = None) -> list[str] | DataFrame:
    """The terms that fit: a list, which scans can be told, if there are at most PUSHED; else a table."""
    terms = expansions(index, pattern, vocabulary)
    some = [r[0] for r in terms.limit(PUSHED + 1).collect()]
    return sorted(some) if len(some) <= PUSHED else terms


def wildcard_scores(index: Index, terms: list[str] | DataFrame) -> DataFrame:
    """doc_id, score: the sum of the weights of all expansions."""
    return index.weights(terms).groupBy("doc_id").agg(F.sum("tfidf").alias("score"))


def _places(slot: Column, bases: Column) -> Column:
    """Where a first word would stand exactly before each expansion of the slot, over all offsets."""
    return F.array_distinct(F.flatten(F.transform(slot, lambda e: F.flatten(F.transform(bases, lambda b: F.transform(e["positions"], lambda q: q - b - e["len"] - 2))))))


def _next_offsets(slot: Column, bases: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(bases, lambda b: F.transform(slot, lambda e: b + e["len"] + 2))))


def wildcard_phrase_scores(index: Index, query: Query, vocabulary: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """doc_id, score: the largest weight of a first word that begins a matching phrase (strict: all later words are near their places). Slots meet by document, so no product of expansions is built."""

    def slot(word: str, i: int) -> DataFrame:
        rows = index.weights(expanded(index, word, vocabulary) if "*" in word else [word])
        return rows.select("doc_id", *([F.col("tfidf"), F.col("positions").alias("p0")] if i == 0 else [F.length("term").alias("len"), "positions"]))

    first, later = slot(query.words[0], 0), [slot(w, i) for i, w in enumerate(query.words[1:], 1)]
    rows, docs, bases = first, None, F.array(F.lit(0))
    for i, s in enumerate(later, 1):
        # every expansion of the slot in the document, and their places, once a document; offsets: all sums of the lengths that the slots up to it may have
        own = s.groupBy("doc_id").agg(F.collect_list(F.struct("len", "positions")).alias(f"s{i}"))
        docs = (own if docs is None else docs.join(own, "doc_id")).withColumn(f"b{i - 1}", bases)
        docs = docs.withColumn(f"t{i}", _places(F.col(f"s{i}"), F.col(f"b{i - 1}")))
        bases = _next_offsets(F.col(f"s{i}"), F.col(f"b{i - 1}"))
    if later:
        places = [f"t{i}" for i in range(1, len(later) + 1)]
        around = F.flatten(F.transform("p0", lambda p: F.sequence(p - PROXIMITY, p + PROXIMITY)))
        tests = [F.arrays_overlap(around, F.col(t)) for t in places]
        rows = rows.join(docs.select("doc_id", *places), "doc_id").where(reduce(Column.__and__ if strict else Column.__or__, tests))
    return rows.groupBy("doc_id").agg(F.max("tfidf").alias("score"))


def word_batch(index: Index, queries: list[tuple[int, dict[str, float], list[frozenset]]], ranges: dict[str, list[tuple[int, int]]] | None = None) -> DataFrame:
    """qid, doc_id, score of (qid, shares of words, products) as one plan: documents with all words of some product, which are those of a boolean query in
    disjunctive form; an empty product asks for any word. ranges: all that is read of each word (plans/blocks.py)."""
    rows, wanted = [], []
    for i, shares, products in queries:
        slot = {w: k for k, w in enumerate(sorted(set().union(*products)))}
        rows += [(i, w, v, 1 << slot[w] if w in slot else 0) for w, v in shares.items()]
        wanted.append((i, [sum(1 << slot[w] for w in p) for p in products]))
    spark = index.postings.sparkSession
    terms, wanted = spark.createDataFrame(rows, "qid int, term string, share double, bit long"), spark.createDataFrame(wanted, "qid int, products array<long>")
    found = index.weights(sorted({r[1] for r in rows}), ranges).join(F.broadcast(terms), "term")  # the parsed queries, which the driver holds
    found = found.groupBy("qid", "doc_id").agg(F.sum(F.col("share") * F.col("tfidf")).alias("score"), F.bit_or("bit").alias("bits"))
    found = found.join(F.broadcast(wanted), "qid")  # one row for each query
    return found.where(F.exists("products", lambda p: F.col("bits").bitwiseAND(p) == p)).select("qid", "doc_id", "score")


def scores(index: Index, docs: DataFrame, query: Query) -> DataFrame:
    """doc_id, score of docs: the sum over the query's words of their share in it times their weight in the document."""
    share = F.create_map(*[x for w, v in query.weights.items() for x in (F.lit(w), F.lit(v))])
    parts = index.weights(sorted(query.weights)).select(F.col("doc_id").alias("_doc"), (share[F.col("term")] * F.col("tfidf")).alias("part"))
    return docs.join(parts, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").groupBy("doc_id").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("score"))


def evaluate(index: Index, queries: list[tuple[int, Query]], vocabulary: DataFrame | None = None, strict: bool = False, k: int | None = None) -> DataFrame:
    """qid, doc_id, score of all queries (k: at least of the best k of each). Words, boolean queries and wildcards share one plan, phrases another; what is too large for that stands alone."""
    words, phrases, parts = [], [], []
    alone = lambda i, found: parts.append(found.select(F.lit(i).alias("qid"), "doc_id", "score"))
    for i, q in queries:
        if not q.words:
            continue
        if q.kind == qlang.PHRASE:
            phrases.append((i, q))
        elif q.kind == qlang.WILDCARD_PHRASE and len(q.words) > 1:
            alone(i, wildcard_phrase_scores(index, q, vocabulary, strict))
        elif q.kind in (qlang.WILDCARD, qlang.WILDCARD_PHRASE):
            terms = expanded(index, q.words[0], vocabulary)
            if isinstance(terms, DataFrame):
                alone(i, wildcard_scores(index, terms))
            elif terms:
                words.append((i, dict.fromkeys(terms, 1.0), [frozenset()]))
        elif q.kind == qlang.BOOLEAN:
            products = qlang.products(q.tree)
            if products is None:
                alone(i, scores(index, boolean_docs(index, q), q))
            elif products:
                words.append((i, q.weights, products))
        else:
            words.append((i, q.weights, [frozenset()]))
    if words:
        rounded = lambda some, ranges: word_batch(index, some, ranges).withColumn("score", F.round("score", 6))
        parts.append(word_batch(index, words, blocks.needed(index, words) if k is None else blocks.best(index, words, k, rounded)))
    parts += ([phrase_batch(index, phrases, strict)] if phrases else [])
    if not parts:
        return index.postings.sparkSession.createDataFrame([], "qid int, doc_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def ranked(found: DataFrame, k: int | None = None, by_ranges: bool = False) -> DataFrame:
    """found (qid, doc_id, score) with rank, by score, then doc_id.

    A query's matches meet in one task, which sorts on disk what does not fit, and with k keeps k rows only; by_ranges deals
    them out by score instead and numbers them, at the price of writing them twice.
    """
    if by_ranges:
        placed = numbered(staged(found, "found"), "qid", F.desc("score"), "doc_id", name="place")
        first = staged(placed.groupBy("qid").agg(F.min("place").alias("first")), "first")
        found = placed.join(small_side(first), "qid").select("qid", "doc_id", "score", (F.col("place") - F.col("first") + 1).cast("int").alias("rank"))
    else:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))
    return found if k is None else found.where(F.col("rank") <= k)


def search(index: Index, queries: list[tuple[int, str]], stopwords=(), vocabulary: DataFrame | None = None, strict: bool = False, k: int | None = None, titles: DataFrame | None = None, by_ranges: bool = False) -> DataFrame:
    """qid, query, qtype, rank, doc_id, score of all matches (k: of the best k), by score, then doc_id. titles: id, title, joined. by_ranges: see ranked."""
    parsed = [(i, qlang.parse(q, stopwords, index.stemmed)) for i, q in queries]
    spark = index.postings.sparkSession
    asked = {w for _, q in parsed for w in q.words}
    stars = sorted(w for w in asked if "*" in w)
    if not (stars and vocabulary is not None):  # else terms are found by their surface forms
        index = index.narrowed(sorted(asked.difference(stars)), stars)
    found = evaluate(index, parsed, vocabulary, strict, k).withColumn("score", F.round("score", 6))
    names = spark.createDataFrame([(i, q.text, q.kind) for i, q in parsed], "qid int, query string, qtype string")
    out = ranked(found, k, by_ranges).join(F.broadcast(names), "qid").select("qid", "query", "qtype", "rank", "doc_id", "score")  # the queries again
    return out if titles is None else out.join(titles.select(F.col("id").alias("doc_id"), "title"), "doc_id", "left")


def surface_vocabulary(docs: DataFrame, stopwords=None) -> DataFrame:
    """term, stem of the surface words, for wildcards over a stemmed index."""
    return T.porter_stems(T.tokens(docs, stopwords).where(F.length("term") < T.MAX_TERM).select("term").distinct())
