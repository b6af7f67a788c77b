"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled training texts: entries that a significance test finds likelier
in toxic ones. Features: densities of lexicon hits, their strength, how near they stand to second-person words,
shares of capitals, punctuation, exclamation marks, and of words with digits, symbols or repeated letters inside (obfuscation).
The labelled rows, at most SAMPLE of them, are dealt out by a hash of their doc_id: a quarter calibrates, and neither the lexicon nor the
trees see it. No feature depends on other texts of a batch.

Defined cases: null and empty texts have zero features and a score like any text; labels that are null are not
learned from, repeated ones count as they stand; without labels of both kinds the score is the share of toxic labels (0 without any);
null doc_id is never labelled and not held out; every input row gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._stage import small_side, staged

#: Labelled rows that the classifier is fitted on at most, those first by a hash.
SAMPLE = 100_000
#: An entry is likelier by this factor in toxic texts, and so with a log likelihood ratio of SURE over chance.
ODDS, SURE = 8.0, 12.0
PREFIX = 5
#: Second-person words, lower case.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros".split()
U = np.uint64
FEATURES = 12


def _entries(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word without outer punctuation, and of its first PREFIX bytes (0: shorter)."""
    letter = ((w.buf >= 97) & (w.buf <= 122)) | (w.buf >= 128) | ((w.buf >= 48) & (w.buf <= 57))
    before = np.maximum.accumulate(np.where(letter, np.arange(len(letter)), -1)) if len(letter) else np.zeros(0, int)
    after = np.minimum.accumulate(np.where(letter, np.arange(len(letter)), len(letter))[::-1])[::-1] if len(letter) else before
    start, end = np.maximum(after[w.start], w.start), np.maximum(before[w.end - 1] + 1, w.start)
    start = np.minimum(start, end)
    core = W.Words(w.buf, w.offsets, start, end, w.at).hashes()
    core[end == start] = 0
    head = W.Words(w.buf, w.offsets, start, np.minimum(end, start + PREFIX), w.at).hashes() ^ U(0x5851F42D4C957F2D)
    head[end - start < PREFIX] = 0
    return core, head


COUNTS = pa.schema([("key", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _fold(k, t, c):
    by = np.argsort(k, kind="stable")
    k, t, c = k[by], t[by], c[by]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(t, first), np.add.reduceat(c, first)


def _count(batches):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        return _fold(*(np.concatenate(x) for x in zip(*held, strict=True)))

    size = 0
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, buf, at in W.chunks(batch.column(0)):
            w = W.split(buf, at, lower=True)
            doc = W.segment_ids(w.at)
            keys, docs = [], []
            for k in _entries(w):
                by = np.lexsort((k, doc))
                k, d = k[by], doc[by]
                new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
                new &= k != 0
                keys.append(k[new])
                docs.append(d[new])
            k, d = np.concatenate(keys), np.concatenate(docs)
            if not len(k):
                continue
            t = label[i:j][d].astype(np.int64)
            held.append(_fold(k, t, 1 - t))
            size += len(held[-1][0])
            if size > 2_000_000:
                held[:] = [merged()]
                size = min(1_500_000, len(held[0][0]))
    if held:
        k, t, c = merged()
        for i in range(0, len(k), 200_000):
            yield W.table(COUNTS, W.signed(k[i : i + 200_000]), t[i : i + 200_000], c[i : i + 200_000])


class Lexicon:
    def __init__(self, keys: np.ndarray, weight: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.weight = keys[by], weight[by]

    def of(self, k: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(k))
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.weight[at], 0.0)


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """From all rows of labelled (text, toxic), at most SAMPLE of them, which bounds the entries."""
    n1, n0 = labelled.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    counts = labelled.select("text", "toxic").mapInArrow(_count, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") + 0.5) / (n1 + 1.0) / ((F.col("clean") + 0.5) / (n0 + 1.0))
    base, n = (n1 + 0.5) / (n1 + n0 + 1.0), F.col("toxic") + F.col("clean")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / n / F.lit(p))).otherwise(0.0)
    sure = part("toxic", base) + part("clean", 1 - base)
    found = counts.where((ratio >= ODDS) & (sure >= SURE)).select("key", F.log(ratio).alias("weight")).toPandas()
    return Lexicon(found["key"].to_numpy(np.int64).copy().view(U), found["weight"].to_numpy(float).copy())


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    out = []
    person = W.split(*_joined(SECOND_PERSON)).hashes()
    for _, _, buf, at in W.chunks(column):
        w = W.split(buf, at, lower=True)
        n, size = w.counts.astype(float), np.diff(at).astype(float)
        doc = W.segment_ids(w.at)
        core, head = _entries(w)
        whole, begin = lexicon.of(core), lexicon.of(head)
        best = np.maximum(whole, begin)
        per = lambda x: np.bincount(doc, x, len(n))
        hit = best > 0
        far = 1000
        at_word = np.arange(len(core)) + far * (doc + 1)  # words of different texts are far apart
        you = np.isin(core, person)
        last = np.maximum.accumulate(np.where(you, at_word, -far)) if len(core) else at_word
        following = np.minimum.accumulate(np.where(you, at_word, 1 << 60)[::-1])[::-1] if len(core) else at_word
        near = hit & (np.minimum(at_word - last, following - at_word) <= 4)
        cells = lambda mask: np.bincount(np.repeat(np.arange(len(n)), np.diff(at)), mask, len(n))
        raw = buf
        letter = ((w.buf >= 97) & (w.buf <= 122)) | (w.buf >= 128)
        mark = ((raw > 32) & (raw < 48)) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 127))
        odd = (raw >= 48) & (raw <= 57) | (raw == 42) | (raw == 64) | (raw == 36)
        inside = np.zeros(len(core), bool)
        if len(core):
            mid = odd.copy()
            mid[w.start] = False
            mid[w.end - 1] = False
            tripled = np.zeros(len(raw), bool)
            tripled[2:] = (w.buf[2:] == w.buf[1:-1]) & (w.buf[1:-1] == w.buf[:-2]) & letter[2:]
            tripled[w.start] = False
            tripled[np.minimum(w.start + 1, w.end - 1)] = False
            inside = (np.logical_or.reduceat(mid, w.start) & np.logical_or.reduceat(letter, w.start)) | np.logical_or.reduceat(tripled, w.start)
        top = np.zeros(len(n))
        np.maximum.at(top, doc, best)
        n1, s1 = np.maximum(n, 1), np.maximum(size, 1)
        out.append(np.column_stack([per(hit), per(hit) / n1, per(best) / n1, top, per(whole > 0), per(whole) / n1, per(near), per(near) / n1, cells((raw >= 65) & (raw <= 90)) / s1, cells(mark) / s1, cells(raw == 33) / s1, per(inside) / n1]))
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    b = " ".join(words).encode()
    return np.frombuffer(b, np.uint8), np.array([0, len(b)])


class Trees:
    """Boosted regression trees for the logistic loss, on binned features, with exact leaf steps."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)])
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), {}
            for level in range(self.depth):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    rows = np.flatnonzero(node == k)
                    if (split := self._split(b[rows], g[rows], h[rows])) is not None:
                        tree[k] = split
                        node[rows] = 2 * k + 1 + (b[rows, split[0]] > split[1])
            leaves = np.zeros((1 << (self.depth + 1)) - 1)
            for k in np.unique(node):
                rows = node == k
                leaves[k] = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
            f += leaves[node]
            self.trees.append((tree, leaves))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        best, at = 1e-6, None
        if len(g) < 2 * self.least:
            return None
        gain = lambda s, w: s * s / (w + 1.0)
        for j in range(b.shape[1]):
            n, s, w = (np.cumsum(np.bincount(b[:, j], v, self.bins)) for v in (None, g, h))
            left = gain(s, w) + gain(s[-1] - s, w[-1] - w) - gain(s[-1], w[-1])
            left[(n < self.least) | (n[-1] - n < self.least)] = 0
            k = int(left.argmax())
            if left[k] > best:
                best, at = left[k], (j, k)
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)])
        f = np.full(len(x), self.base)
        for tree, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for k in sorted(tree):
                rows = node == k
                node[rows] = 2 * k + 1 + (b[rows, tree[k][0]] > tree[k][1])
            f += leaves[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y by x (pooling adjacent violators), smoothed off 0 and 1."""
    by = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[by].tolist(), y[by].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    value = lambda s, n: (s + 0.25) / (n + 0.5)
    knots = [(v, value(s, n)) for s, n, low, high in blocks for v in ((low, high) if high > low else (low,))]
    at, to = (np.array(v) for v in zip(*knots, strict=True))
    return at, np.maximum.accumulate(to)


class Classifier:
    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        """The held rows calibrate; the others grow the trees. Where either lacks a label, all rows do both."""
        self.share, self.trees = (float(y.mean()) if len(y) else 0.0), None
        if len(np.unique(y)) == 2:
            if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
                held = np.zeros(len(y), bool)
            self.trees = Trees().fit(x[~held], y[~held])
            on = held if held.any() else ~held
            self.at, self.to = isotonic(self.trees.margin(x[on]), y[on])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.interp(self.trees.margin(x), self.at, self.to)


def train(labelled: DataFrame) -> tuple[Lexicon, Classifier]:
    """labelled: doc_id, text, toxic (0 or 1). Of more than SAMPLE rows, about SAMPLE are used, drawn by a hash."""
    turn = F.xxhash64("doc_id", F.lit(7))
    rows = labelled.count()
    if rows > SAMPLE:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 40)) < int(SAMPLE / rows * (1 << 40)))
    held = F.pmod(turn, F.lit(4)) == 3
    lexicon = learn_lexicon(labelled.where(~held))
    shared = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            x = features(batch.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (1, 2, 3)), *map(pa.array, np.ascontiguousarray(x.T))], names=["turn", "toxic", "held", *(f"f{i}" for i in range(FEATURES))])

    schema = "turn long, toxic int, held boolean, " + ", ".join(f"f{i} double" for i in range(FEATURES))
    found = labelled.select("text", turn.alias("turn"), F.col("toxic").cast("int"), held.alias("held"))
    found = found.mapInArrow(run, schema).toPandas()  # about SAMPLE rows of FEATURES numbers
    found = found.sort_values(["turn", "toxic", *(f"f{i}" for i in range(FEATURES))], kind="stable")
    return lexicon, Classifier(found.iloc[:, 3:].to_numpy(float), found["toxic"].to_numpy(float), found["held"].to_numpy(bool))


def classify(docs: DataFrame, lexicon: Lexicon, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, classifier))

    def run(batches):
        for batch in batches:
            score = shared.value[1].score(features(batch.column(2), shared.value[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("of"), "toxic")
    labelled = staged(docs.where("not held_out").join(small_side(labels), F.col("doc_id") == F.col("of")).select("doc_id", "text", "toxic"), "labelled")
    return classify(docs, *train(labelled))
