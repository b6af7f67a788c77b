"""The best k of many queries at once, document shard by document shard: all queries meet the postings of a shard in one task, which reads a term's postings by weight only
as far as they may still reach the kth score. Rows of (query, document) are not made for all matches, of which there are as many as queries times documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.shared import BROADCAST_ROWS, ship_package, small_side

#: Postings of a shard, and queries that meet them in one task: about 200 MB each.
SHARD_ROWS, SHARD_QUERIES = 4_000_000, 500_000
#: Scores are ranked as rounded to UNIT; two sums of the same weights differ by less than SLACK units.
UNIT, SLACK = 1e6, 1e-3
#: Postings of a term that are looked at first, and results that leave a task together.
FIRST, ROWS = 64, 100_000
_NO_DOC = -(1 << 63)
#: Types of doc_id that can be dealt with here.
IDS = {"int": pa.int32(), "bigint": pa.int64()}


class Shard:
    """Postings of whole documents: code of the term, doc_id, weight. All weights are 0 or more."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray, weights: np.ndarray):
        self.ids, local = np.unique(docs, return_inverse=True)
        order = np.lexsort((local, codes))
        self.docs, self.weights = local[order].astype(np.int32), weights[order]
        known, starts = np.unique(codes[order], return_index=True)
        self.span = {c: (a, z) for c, a, z in zip(known.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True)}
        self._falling: dict[int, np.ndarray] = {}
        self._top: dict[int, float] = {c: m for c, m in zip(known.tolist(), np.maximum.reduceat(self.weights, starts).tolist(), strict=True)} if len(order) else {}

    def falling(self, code: int) -> np.ndarray:
        """Places of the postings of a term, by falling weight."""
        if (at := self._falling.get(code)) is None:
            a, z = self.span[code]
            at = self._falling[code] = (np.argsort(-self.weights[a:z], kind="stable") + a).astype(np.int32)
        return at

    def best(self, terms: list[tuple[int, float, int]], products: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of at least the best k matches. terms: code, share, bit. products: of one of these all bits must be there; of 0 any."""
        terms = [t for t in terms if t[0] in self.span]
        if not terms:
            return self.ids[:0], np.zeros(0)
        if 0 in products:
            ways = [([n], []) for n in range(len(terms))]
        else:
            ways = []
            for p in products:
                needed = [n for n, t in enumerate(terms) if t[2] & p]
                if sum(terms[n][2] for n in needed) == p:
                    needed.sort(key=lambda n: self.span[terms[n][0]][1] - self.span[terms[n][0]][0])  # the fewest postings lead
                    ways.append((needed[:1], needed[1:]))
        floor, docs, scores = -1.0, np.zeros(0, np.int32), np.zeros(0)
        least = 2 * (1 + SLACK) / UNIT  # scores that much below the kth cannot round to it
        for (lead,), _ in (w for w in ways if not w[1]):
            code, share, _ = terms[lead]
            at = self.falling(code)
            if len(at) >= k:
                floor = max(floor, share * self.weights[at[k - 1]] - least)
        for (lead,), needed in ways:
            code, share, _ = terms[lead]
            at, place, step = self.falling(code), 0, max(FIRST, 4 * k)
            others = [(n, *t[:2]) for n, t in enumerate(terms) if n != lead]
            rest = sum(s * self._top[c] for _, c, s in others)
            while place < len(at) and share * self.weights[at[place]] + rest >= floor:
                some = at[place : place + step]
                place, step = place + step, 4 * step
                weight = share * self.weights[some]
                some, weight = self.docs[some], weight
                if floor > 0 and weight[-1] + rest < floor:
                    may = weight + rest >= floor
                    some, weight = some[may], weight[may]
                for n, c, s in sorted(others, key=lambda o: o[0] not in needed):
                    a, z = self.span[c]
                    there = self.docs[a:z]
                    found = np.minimum(np.searchsorted(there, some), z - a - 1)
                    hit = there[found] == some
                    if n in needed:
                        some, weight = some[hit], weight[hit] + s * self.weights[a + found[hit]]
                    else:
                        weight = weight + np.where(hit, s * self.weights[a + found], 0.0)
                if len(some):
                    docs, first = np.unique(np.concatenate([docs, some]), return_index=True)
                    scores = np.concatenate([scores, weight])[first]
                    if len(scores) >= k:
                        floor = max(floor, np.partition(scores, len(scores) - k)[len(scores) - k] - least)
                        keep = scores >= floor
                        docs, scores = docs[keep], scores[keep]
        return self._cut(docs, scores, k)

    def _cut(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k by rounded score, then doc_id, and those whose rounding may put them among these."""
        if len(docs) > k:
            low, high = np.floor(scores * UNIT + 0.5 - SLACK), np.floor(scores * UNIT + 0.5 + SLACK)
            order = np.lexsort((docs, -low))
            keep = (low != high) & (high >= low[order[k - 1]])
            keep[order[:k]] = True
            docs, scores = docs[keep], scores[keep]
        return self.ids[docs], scores


def evaluator(k: int, id_type: pa.DataType):
    """For mapInArrow over the rows of some shards, which are postings (code, doc_id, weight) or queries (qid, asked): qid, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list]] = {}
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            for x in np.unique(shard).tolist():
                here = batch.filter(pa.array(shard == x))
                asked = here.filter(pc.is_valid(here.column("qid")))
                rows = here.filter(pc.is_null(here.column("qid")))
                part = parts.setdefault(x, [[], [], [], []])
                if len(rows):
                    part[0].append(np.asarray(rows.column("code")))
                    part[1].append(np.asarray(rows.column("doc_id").cast(pa.int64()).fill_null(_NO_DOC)))
                    part[2].append(np.asarray(rows.column("weight")))
                if len(asked):
                    part[3].append(asked.select(["qid", "asked"]))
        for *rows, queries in parts.values():
            if rows[0] and queries:
                yield from _answers(Shard(*map(np.concatenate, rows)), queries, k, id_type)

    return run


def _answers(shard: Shard, queries: list[pa.RecordBatch], k: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    qids, docs, scores, n = [], [], [], 0

    def out() -> pa.RecordBatch:
        ids = np.concatenate(docs)
        ids = pa.array(ids, mask=ids == _NO_DOC).cast(id_type)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qids, np.int64), [len(d) for d in docs])), ids, pa.array(np.concatenate(scores))], ["qid", "doc_id", "score"])

    for batch in queries:
        for qid, text in zip(batch.column("qid").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            terms, _, products = text.partition("|")
            each = [(int(c), float(share), int(bit)) for c, share, bit in (t.split(":") for t in terms.split())]
            found, score = shard.best(each, [int(p) for p in products.split()], k)
            if len(found):
                qids.append(qid)
                docs.append(found)
                scores.append(score)
                n += len(found)
            if n >= ROWS:
                yield out()
                qids, docs, scores, n = [], [], [], 0
    if n:
        yield out()


def best(index: Index, words: DataFrame, terms: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score of the best k matches of each query and of some that are not. words: qid, term, share, bit. terms: term, df of all of them that the index has, code.
    queries: qid, products."""
    spark = index.postings.sparkSession
    ship_package(spark)
    asked, n = terms.agg(F.sum("df")).first()[0] or 0, queries.count()
    shards, blocks = max(spark.sparkContext.defaultParallelism, -(-asked // SHARD_ROWS)), max(1, -(-n // SHARD_QUERIES))
    few = terms.count() <= BROADCAST_ROWS
    each = lambda c, x: (F.col(c) if x is None else F.lit(None).cast(x)).alias(c)
    id_type = index.postings.schema["doc_id"].dataType.simpleString()
    kinds = {"code": "bigint", "doc_id": id_type, "weight": "double", "qid": "bigint", "asked": "string"}

    def dealt(rows: DataFrame, shard, *own: str) -> DataFrame:
        return rows.select(shard.cast("int").alias("shard"), *[each(c, None if c in own else kinds[c]) for c in kinds])

    p = index.postings.select("term", "doc_id", "tf", F.col(index.size).alias("_size")).join(F.broadcast(terms) if few else terms.hint("merge"), "term")
    p = p.withColumn("weight", F.col("tf") / F.col("_size") * F.log(F.lit(float(max(1, index.n_docs))) / F.col("df")))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    p = p.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else p.withColumn("_block", F.lit(0))
    # as text: nested columns are slow on their way to Python
    q = words.join(F.broadcast(terms) if few else terms.hint("merge"), "term").groupBy("qid").agg(F.array_join(F.collect_list(F.concat_ws(":", "code", "share", "bit")), " ").alias("terms"))
    q = q.join(small_side(queries), "qid").withColumn("asked", F.concat("terms", F.lit("|"), F.array_join(F.col("products").cast("array<string>"), " "))).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    rows = dealt(p, F.col("_block") * shards + shard, "code", "doc_id", "weight").unionByName(dealt(q, block * shards + F.col("_shard"), "qid", "asked"))
    return rows.repartitionById(shards * blocks, F.col("shard")).mapInArrow(evaluator(k, IDS[id_type]), f"qid long, doc_id {id_type}, score double")
