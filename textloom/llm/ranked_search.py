"""Ranked lexical search of a query set over all documents by a threshold-seeded join.

For the terms of the items an index of the documents is written: one row for each text, with its length and its terms and frequencies. Over it
stand, for each term, the weight, the best impact and the kth best impact, kept as a table. They seed the search: an item's kth score is
at least its largest weighted kth impact. Terms of an item, taken from the largest possible part of a score to the smallest, are pruned from where the rest
together stays below that threshold; a document with pruned terms only cannot be among the k. The other terms generate
candidates; those whose parts and the pruned rest reach the threshold are scored exactly, and the kth best score found so far by a task raises its threshold.

Documents never leave their partition: the items are the side that is broadcast, in blocks of at most ENTRIES terms and ITEMS items, each of which reads
all documents. A task returns at most k rows for each item. Bounds are floating, with a margin; scores are exact 64-bit integers.

Defined cases: null and empty texts have no terms; each row of documents and of items is one of its own, also where ids repeat (a repeated item has ranks of its own)
or are null; null doc_id comes last among equal scores; items without any match have no rows; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words
from ._stage import forget, staged
from .source_audit import ascii_lower

#: Digits and letters of the ASCII range and all characters beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
K, ENTRIES, ITEMS = 50, 1_000_000, 20_000
#: Scores of documents and items that are held at once.
CELLS = 4_000_000
_LAST = np.iinfo(np.int64).max
INDEX = "doc_id long, n long, terms array<int>, tf array<int>"
FOUND = "item int, doc_id long, score long"


class Vocabulary:
    """Terms by number. A word is one of them if the bytes are; hashes only say which to compare with."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.words = _words.Words(np.frombuffer(b"".join(raw), np.uint8), ends[-1:], starts, ends, np.zeros(1, np.int64))
        self.seed = 0
        while True:
            h = self.words.hashes(self.seed)
            self.order = np.argsort(h)
            self.sorted = h[self.order]
            if len(h) < 2 or (np.diff(self.sorted) != 0).all():
                break
            self.seed += 1

    def find(self, words: _words.Words) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words are terms, the numbers of these terms)."""
        if not len(words.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes(self.seed)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        which = np.flatnonzero(self.sorted[at] == h)
        number = self.order[at[which]]
        own, their = words.end[which] - words.start[which], self.words.end[number] - self.words.start[number]
        same = own == their
        which, number, own = which[same], number[same], own[same]
        first = np.repeat(np.cumsum(own) - own, own)
        step = np.arange(len(first)) - first
        equal = words.buf[np.repeat(words.start[which], own) + step] == self.words.buf[np.repeat(self.words.start[number], own) + step]
        good = np.logical_and.reduceat(equal, np.cumsum(own) - own) if len(own) else np.zeros(0, bool)
        return which[good], number[good]


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n, terms, tf of each document with a term of any kind: n counts all its terms, the arrays hold those listed, by number."""

    def run(batches):
        vocabulary = Vocabulary(terms)
        for batch in batches:
            for i, j, buf, at in _words.chunks(batch.column(1)):
                words = _words.split(buf, at, lower=True, between=_BETWEEN)
                n = words.counts
                which, number = vocabulary.find(words)
                doc = _words.segment_ids(words.at)[which]
                key, tf = np.unique(doc * len(terms) + number, return_counts=True)
                ends = _words.cumulative(np.bincount(key // len(terms), minlength=j - i))
                lists = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), lists(key % len(terms)), lists(tf)], names=["doc_id", "n", "terms", "tf"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def postings(indexed: DataFrame) -> DataFrame:
    """term, impact of each posting."""
    each = indexed.select("m", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("m", F.col("x.terms").alias("term"), F.col("x.tf").cast("long").alias("tf"))
    return each.select("term", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("impact"))


def term_table(indexed: DataFrame, n_docs: int, k: int) -> DataFrame:
    """term, weight, best, kth (0 for terms of less than k documents): what the search is seeded with."""
    counted = staged(postings(indexed).groupBy("term", "impact").agg(F.count("*").alias("n")), "impacts")
    df = counted.groupBy("term").agg(F.sum("n").alias("df"))
    own = Window.partitionBy("term").orderBy(F.desc("impact"))
    top = counted.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k)  # k values hold the best k documents at least
    top = top.withColumn("seen", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    top = top.groupBy("term").agg(F.max("impact").alias("best"), F.coalesce(F.max(F.when(F.col("seen") >= k, F.col("impact"))), F.lit(0)).alias("kth"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return df.join(top, "term").select("term", weight.alias("weight"), "best", "kth")


def plan(entries: DataFrame, table: DataFrame) -> DataFrame:
    """item, term, weight, floor (what the item's kth score is at least), rest (what this term and those after it add at most), of terms that documents have."""
    part = F.col("weight") * F.col("best")
    own = Window.partitionBy("item")  # the terms of one item
    rows = entries.join(table, "term").withColumn("floor", F.max(F.col("weight") * F.col("kth")).over(own))
    return rows.withColumn("rest", F.sum(part).over(own.orderBy(part, F.desc("term")).rowsBetween(Window.unboundedPreceding, 0))).select("item", "term", "weight", "floor", "rest")


def _by(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, where each key's rows begin)."""
    return np.argsort(key, kind="stable"), _words.cumulative(np.bincount(key, minlength=size))


def _spread(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of keys, place in the sorted rows) for all rows of each key."""
    n = at[keys + 1] - at[keys]
    which = np.repeat(np.arange(len(keys)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + at[keys][which]


def _best(item, doc, score, k):
    """The best k rows of each item."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    keep = rank < k
    return item[keep], doc[keep], score[keep], rank[keep]


def candidates(rows: np.ndarray, n_items: int, n_terms: int, k: int):
    """The task of the search. rows: item, term, weight, floor, rest of the plan, as lines of an array."""
    item, term, weight, floor, rest = rows
    seed = np.zeros(n_items, np.int64)
    seed[item] = floor
    essential = rest >= floor
    pruned = np.zeros(n_items, np.int64)
    np.maximum.at(pruned, item[~essential], rest[~essential])
    order, at_term = _by(term[essential], n_terms)
    e_item, e_weight = item[essential][order], weight[essential][order].astype(float)
    order, at_item = _by(item, n_items)
    a_term, a_weight = term[order], weight[order]

    def exact(key, impact, doc, which):
        """Scores of documents and items: the sum over all terms of the item."""
        c, place = _spread(at_item, which)
        wanted = doc[c] * n_terms + a_term[place]
        found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        part = np.where(key[found] == wanted, impact[found] * a_weight[place], 0)
        return np.add.reduceat(part, np.cumsum(at_item[which + 1] - at_item[which]) - (at_item[which + 1] - at_item[which]))

    def run(batches):
        none = np.zeros(0, np.int64)
        top, floor = (none, none, none), seed.copy()
        for batch in batches:
            lists, tf = batch.column(2), batch.column(3)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds, terms, tfs = bounds - bounds[0], lists.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)
            ids = batch.column(0).fill_null(_LAST).to_numpy()
            m = batch.column(1).to_numpy()
            step = max(1, CELLS // max(1, n_items))
            for i in range(0, len(m), step):
                j = min(len(m), i + step)
                part = slice(bounds[i], bounds[j])
                doc, t, f = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1])), terms[part], tfs[part]
                if not len(doc):
                    continue
                impact = (1_000_000_000 * f) // (1000 * f + 20 * m[i:j][doc])
                which, place = _spread(at_term, t)
                got = np.bincount(doc[which] * n_items + e_item[place], impact[which] * e_weight[place], minlength=(j - i) * n_items)
                cell = np.flatnonzero(got)
                of = cell % n_items
                cell = cell[got[cell] * (1 + 1e-9) + pruned[of] + 1 >= floor[of]]
                for c in range(0, len(cell), 100_000):
                    own = cell[c : c + 100_000]
                    d, of = own // n_items, own % n_items
                    score = exact(doc * n_terms + t, impact, d, of)
                    good = (score > 0) & (score >= floor[of])
                    new = (of[good], ids[i:j][d[good]], score[good])
                    *top, rank = _best(*(np.concatenate(x) for x in zip(top, new, strict=True)), k)
                    full = rank == k - 1
                    floor[top[0][full]] = np.maximum(floor[top[0][full]], top[2][full])
        for c in range(0, len(top[0]), 100_000):
            item, ids, score = (x[c : c + 100_000] for x in top)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, entries: int = ENTRIES, item_limit: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each item, all with a score above 0 if fewer. items: item_id, text."""
    rows = staged(items.select("item_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text")).withColumn("_row", F.monotonically_increasing_id()), "items")
    asked = staged(rows.select("_row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("word")), "words")
    n_entries, n_items = asked.count(), rows.count()
    blocks = max(1, -(-n_entries // entries), -(-n_items // item_limit))
    out = None
    for b in range(blocks):
        found = _block(docs, asked.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b), k)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(rows.select("_row", "item_id"), "_row").select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """_row, doc_id, score: what any task has among its best k. A block's words and plan pass through the driver: at most ENTRIES rows, or one item."""
    spark = docs.sparkSession
    terms = sorted(r[0] for r in asked.select("word").distinct().collect())
    named = {r: i for i, r in enumerate(sorted(r[0] for r in asked.select("_row").distinct().collect()))}
    if not terms:
        return spark.createDataFrame([], "_row long, doc_id long, score long")
    indexed = staged(index(docs, terms), "index")
    total = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total[0]:
        return spark.createDataFrame([], "_row long, doc_id long, score long")
    measured = indexed.withColumn("m", F.expr(f"50 + (50 * n * {total[0]}L) div {total[1]}L"))
    table = staged(term_table(measured, total[0], k), "terms")
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "word string, term int")
    items = spark.createDataFrame(list(named.items()), "_row long, item int")
    entries = asked.join(numbers, "word").join(items, "_row").select("item", "term")
    planned = plan(entries, table).toPandas()
    lines = planned[["item", "term", "weight", "floor", "rest"]].to_numpy(np.int64).T.copy()
    found = measured.select("doc_id", "m", "terms", "tf").mapInArrow(candidates(lines, len(named), len(terms), k), FOUND)
    found = staged(found.join(F.broadcast(items), "item").select("_row", "doc_id", "score"), "found")  # as many rows as the block has items
    forget(indexed)
    return found


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
