"""Posting blocks: what the stored index says of a term's postings range by range of doc_id, and how searches skip ranges by it.

A row of the table of blocks holds term, block, postings, first and last doc_id, and the best tf / size; a block that a batch of postings ends in has a row more. An index has at most
BLOCKS ranges, so the rows of the words of a query are few and come to the driver. Words that must stand together are read only where all of them have a block and their ranges meet; with k given,
the blocks that may hold the best are scored first, and what cannot reach the kth score found there is not read. What is to be read reaches
the scan as ranges of doc_id by term; postings are sorted by term and doc_id, so row groups and pages outside are skipped.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.index import Index, among

#: Ranges of a term that a scan is told; nearest ones are joined beyond.
RANGES = 64
#: Scores are rounded to six digits before they are ranked.
MARGIN = 2e-6


def block_rows(index: Index, words: set[str]) -> dict[str, dict[int, tuple]]:
    """For each word its blocks: (postings, first, last, best)."""
    out: dict[str, dict[int, tuple]] = {w: {} for w in words}
    for r in index.blocks.where(among(sorted(words))).collect():
        n, first, last, best = out[r.term].get(r.block, (0, r.first, r.last, r.best))  # a block may stand in several rows
        out[r.term][r.block] = (n + r.n, min(first, r.first), max(last, r.last), max(best, r.best))
    return out


def meeting(rows: dict[str, dict[int, tuple]], words: frozenset) -> dict[int, tuple[int, int]]:
    """Ranges, by block, in which all words have postings."""
    some, *more = sorted(words, key=lambda w: len(rows[w]))
    out = {b: (x[1], x[2]) for b, x in rows[some].items()}
    for w in more:
        out = {b: (max(a, rows[w][b][1]), min(z, rows[w][b][2])) for b, (a, z) in out.items() if b in rows[w]}
    return {b: (a, z) for b, (a, z) in out.items() if a <= z}


def possible(rows: dict[str, dict[int, tuple]], words: set[str], products: list[frozenset]) -> dict[int, tuple[int, int]]:
    """Ranges, by block, in which a document may match: all words of some product, any word for an empty one."""
    out: dict[int, tuple[int, int]] = {}
    for p in [frozenset([w]) for w in words] if frozenset() in products else products:
        for b, (a, z) in meeting(rows, p).items():
            out[b] = (min(a, out[b][0]), max(z, out[b][1])) if b in out else (a, z)
    return out


def joined(ranges: list[tuple[int, int]], most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all given ones."""
    ranges = sorted(ranges)
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1], reverse=True)[: most - 1]
    cuts = [0, *sorted(gaps), len(ranges)]
    return [(ranges[a][0], max(r[1] for r in ranges[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)] if ranges else []


def _by_term(needed: list[tuple[set[str], dict[int, tuple[int, int]]]]) -> dict[str, list[tuple[int, int]]]:
    """What is to be read of each word, over all queries: (words, ranges by block)."""
    out: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
    for words, blocks in needed:
        for w in words:
            for b, (a, z) in blocks.items():
                old = out[w].get(b, (a, z))
                out[w][b] = (min(a, old[0]), max(z, old[1]))
            out[w]  # a word of nowhere is read nowhere
    return {w: joined(list(x.values())) for w, x in out.items()}


def needed(index: Index, queries: list[tuple[int, dict[str, float], list[frozenset]]]) -> dict[str, list[tuple[int, int]]] | None:
    """For each word the ranges that the queries (qid, shares, products) need; None if the index has no blocks."""
    if index.blocks is None:
        return None
    rows = block_rows(index, {w for _, s, p in queries for w in s})
    return _by_term([(set(s), possible(rows, set(s), p)) for _, s, p in queries])


def bounds(index: Index, rows, shares: dict[str, float], blocks) -> dict[int, float]:
    """What a document of each block can score at most."""
    n = float(max(1, index.n_docs))
    idf = {w: math.log(n / sum(x[0] for x in rows[w].values())) if rows[w] else 0.0 for w in shares}
    return {b: sum(v * idf[w] * rows[w][b][3] for w, v in shares.items() if b in rows[w]) for b in blocks}


def best(index: Index, queries: list[tuple[int, dict[str, float], list[frozenset]]], k: int, score, report: list | None = None) -> dict[str, list[tuple[int, int]]] | None:
    """As needed, for the best k of each query. score(queries, ranges): qid, doc_id, score of what is in the ranges.

    The blocks of the highest bounds that hold k postings of a word are scored first: the kth score there, if there is one, is what the others must reach. report
    takes (qid, blocks in which it may match, blocks that are read).
    """
    if index.blocks is None:
        return None
    rows = block_rows(index, {w for _, s, p in queries for w in s})
    where = {i: possible(rows, set(s), p) for i, s, p in queries}
    high = {i: bounds(index, rows, s, where[i]) for i, s, _ in queries}
    seeds = {}
    for i, s, _ in queries:
        held, seeds[i] = 0, {}
        for b in sorted(high[i], key=lambda b: (-high[i][b], b)):
            if held >= k:
                break
            seeds[i][b] = where[i][b]
            held += max(rows[w][b][0] for w in s if b in rows[w])
    found = score(queries, _by_term([(set(s), seeds[i]) for i, s, _ in queries])).groupBy("qid").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("kth"))
    least = {r.qid: r.kth[0] for r in found.collect() if r.kth}  # a row for each query
    read = {i: {b: where[i][b] for b, top in high[i].items() if top * (1 + 1e-9) + MARGIN >= least.get(i, 0.0)} for i, _, _ in queries}
    if report is not None:
        report += [(i, len(where[i]), len(read[i])) for i, _, _ in queries]
    return _by_term([(set(s), read[i]) for i, s, _ in queries])


def point_lookup(index: Index, pairs: DataFrame) -> DataFrame:
    """term, doc_id, positions of each asked pair (term, doc_id) that has a posting; a few pairs are broadcast, many meet by both keys, so no term is hot."""
    from textloom.shared import small_side

    return index.postings.join(small_side(pairs.select("term", "doc_id").distinct()), ["term", "doc_id"]).select("term", "doc_id", "positions")
