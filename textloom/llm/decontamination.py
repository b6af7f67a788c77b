"""Benchmark decontamination: every passage queries a BM25 index of the test items, with block-max pruning.

Items are the documents of the index. A posting holds a term's impact on an item: its BM25 weight divided by the score that the item
gives to its own words, so a score says what share of an item a passage brings back, and one threshold holds for all items; the plain BM25
score is reported beside it. Postings stand in item order, and for each term and block of BLOCK items that it occurs in, the index has the largest impact. A passage is all
words from one cut of the text to the next but one; cuts are STRIDE apart, so each run of up to STRIDE + 1 words lies
whole in a passage. Letters of any script are lower-cased, and marks at the ends of words ignored.

A passage is dropped if the largest impacts of its terms sum to less than the threshold. For the others the maxima are summed by
block; blocks below the threshold are skipped. In the open blocks, cursors walk the postings of the passage's terms: the pivot
is the first item that the maxima of the terms up to it can bring to the threshold, cursors before it move on to it, and it is scored when all stand on it.
What reaches the threshold is verified: the question part of the item and its answer part (the last third
of its words) must each share enough word 3-grams with the text around the passage.

Defined cases: null text has no passages; null doc_id is reported as null; items that are null or without words match nothing; items of
equal text are reported each; repeated rows report each; an empty benchmark gives an empty result. The index is limited
to SLICE items, which bounds what each task holds: more are searched slice by slice, with the df and mean length of all items. Items are also
searched by bands of lengths, each with a stride of its own, the words of its longest item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, BLOCK, SLICE = 0.5, 0.5, 4, 50_000
#: Numbers in a table of bounds while a chunk of text is searched.
CELLS = 8_000_000
MIN_STRIDE, GRAM = 64, 3
#: Words of the longest items of each band of lengths but the last.
BANDS = (256, 1_024, 4_096, 16_384, 65_536)
U = np.uint64


def _core(w: W.Words) -> np.ndarray:
    """Hashes of words without marks at their ends; a word of marks alone keeps them."""
    letter = ((w.buf >= 97) & (w.buf <= 122)) | (w.buf >= 128) | ((w.buf >= 48) & (w.buf <= 57))
    if not len(w.start):
        return np.zeros(0, U)
    at = np.arange(len(letter))
    before = np.maximum.accumulate(np.where(letter, at, -1))[w.end - 1] + 1
    after = np.minimum.accumulate(np.where(letter, at, len(letter))[::-1])[::-1][w.start]
    some = after < w.end
    return W.Words(w.buf, w.offsets, np.where(some, after, w.start), np.where(some, before, w.end), w.at).hashes()


class ItemIndex:
    """BM25 impacts of terms on items, and their maxima by block. of: (items, mean words, most words, terms, their df) where these are some of the items."""

    def __init__(self, ids: list, texts: list[str], of: tuple | None = None):
        buf, at = W.utf8(pc.utf8_lower(pa.array(texts, pa.string())))
        w = W.split(buf, at, lower=True)
        words, n = _core(w), w.counts
        self.ids, self.n, self.words, self.at = ids, n, words, w.at
        doc = W.segment_ids(w.at)
        self.terms = np.unique(words)
        term = np.searchsorted(self.terms, words)
        pair, tf = np.unique(term.astype(np.int64) * max(1, len(n)) + doc, return_counts=True)
        t, d = pair // max(1, len(n)), pair % max(1, len(n))
        if of is None:
            items, mean, most, df = len(n), n.mean(), int(n.max(initial=0)), np.bincount(t, minlength=len(self.terms))
        else:
            items, mean, most, terms, df = of
            df = df[np.searchsorted(terms, self.terms)]
        self.stride = max(MIN_STRIDE, most)
        idf = np.log1p((items - df + 0.5) / (df + 0.5))
        weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[d] / max(1e-9, mean)))
        own = np.bincount(d, weight, len(n))
        weight /= own[d]
        self.own = own
        # Postings by term in item order, and the maxima of the blocks that have any.
        self.post = np.searchsorted(t, np.arange(len(self.terms) + 1))
        self.item, self.weight = d.astype(np.int32), weight.astype(np.float32)
        self.blocks = -(-len(n) // BLOCK)
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (d[1:] // BLOCK != d[:-1] // BLOCK)]) if len(t) else np.zeros(0, int)
        self.block_post = np.searchsorted(t[first], np.arange(len(self.terms) + 1))
        self.block, self.block_max = (d[first] // BLOCK).astype(np.int32), np.maximum.reduceat(self.weight, first) if len(t) else self.weight
        self.block_key, self.first = t[first] * self.blocks + self.block, np.append(first, len(t))
        self.top = np.maximum.reduceat(self.weight, self.post[:-1]) if len(t) else self.weight
        self.grams = []
        for i in range(len(n)):
            x = words[self.at[i] : self.at[i + 1]]
            cut = len(x) - max(1, len(x) // 3) if len(x) >= 2 * GRAM else len(x)
            self.grams.append((self._shingles(x[:cut]), self._shingles(x[cut:])))

    @staticmethod
    def _shingles(x: np.ndarray) -> np.ndarray:
        return np.unique(W.grams(x, min(GRAM, len(x)))) if len(x) else x

    def overlaps(self, item: int, x: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and of the answer's n-grams that stand among the words x."""
        out = []
        for part in self.grams[item]:
            if not len(part):
                out.append(1.0)
                continue
            g = min(GRAM, self.n[item])
            if part is self.grams[item][1]:
                g = min(GRAM, max(1, self.n[item] // 3))
            out.append(float(np.isin(part, W.grams(x, g)).mean()))
        return out[0], out[1]

    def search(self, words: np.ndarray, at: np.ndarray, threshold: float):
        """(text, item, first word of the passage, score) of each passage that reaches the threshold."""
        none = len(self.terms)
        term = np.minimum(np.searchsorted(self.terms, words), max(0, none - 1))
        term = np.where(self.terms[term] == words, term, none) if none else np.zeros(len(words), int)
        doc = W.segment_ids(at)
        n = np.diff(at)
        cells = np.maximum(1, -(-n // self.stride))
        first_cell = W.cumulative(cells)
        cell = first_cell[doc] + (np.arange(len(words)) - at[doc]) // self.stride
        # Each term counts once in a cell; a passage is two cells, so its bound is at most too high.
        key = np.unique((cell * (none + 1) + term)[term < none])
        c, t = key // (none + 1), key % (none + 1)
        total = int(first_cell[-1])
        last = np.zeros(total + 1, bool)
        last[first_cell[1:] - 1] = True
        begin = np.searchsorted(c, np.arange(total + 1))
        low = threshold - 1e-4
        sums = np.bincount(c, self.top[t], total + 1)[:total] if len(t) else np.zeros(total)
        alive = sums + np.where(last[:total], 0, np.r_[sums[1:], 0]) >= low
        # From here on, only the cells of passages that are left.
        cells_left = np.flatnonzero(alive | np.r_[False, alive[:-1] & ~last[: total - 1]]) if total else np.zeros(0, int)
        n_terms = np.diff(begin)[cells_left]
        full = cells_left[n_terms > 0]
        if not len(full):
            return
        at_term = np.repeat(begin[full] - W.cumulative(n_terms[n_terms > 0])[:-1], n_terms[n_terms > 0]) + np.arange(int(n_terms.sum()))
        used, row = np.unique(t[at_term], return_inverse=True)
        heads = W.cumulative(n_terms[n_terms > 0])[:-1]
        place = np.full(total + 1, len(full))
        place[full] = np.arange(len(full))
        passages = np.flatnonzero(alive)
        one, two = place[passages], np.where(last[passages], len(full), place[passages + 1])
        cell_doc = np.repeat(np.arange(len(n)), cells)
        entries = np.concatenate([np.arange(self.block_post[x], self.block_post[x + 1]) for x in used.tolist()])
        entry_row = np.repeat(np.arange(len(used)), np.diff(self.block_post)[used])
        open_blocks: dict[int, list[int]] = {}
        width = max(16, CELLS // max(1, len(row)))
        for b in range(0, self.blocks, width):
            here = (self.block[entries] >= b) & (self.block[entries] < b + width)
            table = np.zeros((len(used), min(width, self.blocks - b)), np.float32)
            table[entry_row[here], self.block[entries[here]] - b] = self.block_max[entries[here]]
            bound = np.zeros((len(full) + 1, table.shape[1]), np.float32)
            bound[:-1] = np.add.reduceat(table[row], heads, axis=0)
            for i, k in zip(*np.nonzero(bound[one] + bound[two] >= low), strict=True):
                open_blocks.setdefault(int(passages[i]), []).append(b + int(k))
        for p, blocks in sorted(open_blocks.items()):
            d = cell_doc[p]
            span = np.unique(t[begin[p] : begin[p + 1 if last[p] else p + 2]])
            for item, score in self._walk(span, blocks, threshold - 1e-6):
                yield d, item, int(p - first_cell[d]) * self.stride, score

    def _walk(self, terms: np.ndarray, blocks: list[int], threshold: float):
        """(item, score) of the items in open blocks that reach the threshold."""
        for b in blocks:
            key = terms * self.blocks + b
            at = np.searchsorted(self.block_key, key)
            at = at[self.block_key[np.minimum(at, len(self.block_key) - 1)] == key]
            # [item, posting, end in the block, largest impact in the block]
            cursors = [list(c) for c in zip(self.item[self.first[at]].tolist(), self.first[at].tolist(), self.first[at + 1].tolist(), self.block_max[at].tolist(), strict=True)]
            while cursors:
                cursors.sort()
                reach, pivot = 0.0, None
                for c in cursors:
                    reach += c[3]
                    if reach >= threshold:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                if cursors[0][0] == pivot:
                    on = [c for c in cursors if c[0] == pivot]
                    score = float(sum(self.weight[c[1]] for c in on))
                    if score >= threshold:
                        yield pivot, score
                    goal = pivot + 1
                else:
                    goal = pivot
                for c in cursors:
                    while c[1] < c[2] and self.item[c[1]] < goal:
                        c[1] += 1
                    c[0] = int(self.item[c[1]]) if c[1] < c[2] else -1
                cursors = [c for c in cursors if c[1] < c[2]]


OUT = "doc_id long, item_id long, passage_start long, score double, bm25 double, question_overlap double, answer_overlap double"


STATS = pa.schema([("term", pa.int64()), ("n", pa.int64())])


def _stats(batches):
    """(term, items of the batch that have it), and (null, words) for each item with words."""
    for batch in batches:
        w = W.split(*W.utf8(pc.utf8_lower(batch.column(0))), lower=True)
        term = np.unique(_core(w), return_inverse=True)
        pair = np.unique(term[1].astype(np.int64) * max(1, len(w.counts)) + W.segment_ids(w.at))
        n = w.counts[w.counts > 0]
        yield W.table(STATS, W.signed(term[0]), np.bincount(pair // max(1, len(w.counts)), minlength=len(term[0])))
        yield W.table(STATS, pa.nulls(len(n), pa.int64()), n)


def _of_all(items: DataFrame) -> tuple:
    """What ItemIndex takes of all items; one number for each distinct word goes to the driver."""
    rows = items.select("text").mapInArrow(_stats, "term long, n long")
    count, words, most = rows.where("term is null").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    found = rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms, df = found["term"].to_numpy().view(U), found["n"].to_numpy()
    by = np.argsort(terms)
    return count, (words or 0) / max(1, count), most or 0, terms[by], df[by]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """A row for each (document row, item) found and verified, with its best passage.

    Items of each band of lengths are searched with passages of their own length, so a long item changes nothing for short ones.
    """
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    n = F.size(F.array_remove(F.split("text", r"[ \t-\r]+"), ""))
    band = sum(((n > x).cast("int") for x in BANDS), F.lit(0))
    bands = sorted(tuple(r) for r in items.where(n > 0).groupBy(band.alias("band")).agg(F.count("*"), F.max(n)).collect())  # a row for each band
    out, of = None, _of_all(items) if len(bands) > 1 or bands and bands[0][1] > SLICE else None
    for b, count, most in bands:
        slices = -(-count // SLICE)
        for k in range(slices):
            part = items.where((n > 0) & (band == b) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k))
            rows = sorted((tuple(r) for r in part.collect()), key=lambda r: r[0])  # about SLICE items
            if rows:
                found = _search(docs, ItemIndex([r[0] for r in rows], [r[1] for r in rows], of and (*of[:2], most, *of[3:])), threshold, overlap)
                out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], OUT)


def _search(docs: DataFrame, index: ItemIndex, threshold: float, overlap: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        x = shared.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, j, buf, at in W.chunks(pc.utf8_lower(batch.column(1)), W.CHUNK_BYTES // 2):
                w = W.split(buf, at, lower=True)
                words, best = _core(w), {}
                for d, item, start, score in x.search(words, w.at, threshold):
                    a = w.at[d] + max(0, start - 16)
                    q, r = x.overlaps(item, words[a : min(w.at[d + 1], w.at[d] + start + 2 * x.stride + 16)])
                    if q >= overlap and r >= overlap and score > best.get((d, item), (0,))[0]:
                        best[d, item] = (score, start, q, r)
                rows += [(ids[i + d], x.ids[item], s, v, v * float(x.own[item]), q, r) for (d, item), (v, s, q, r) in sorted(best.items())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (*(pa.int64(),) * 3, *(pa.float64(),) * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "passage_start", "score", "bm25", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
