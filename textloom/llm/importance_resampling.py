"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs fall into BUCKETS; one multinomial model is counted on target texts (labelled as good), one
on all texts. A document's log weight is the sum of log(target / raw) over its n-grams. Adding Gumbel noise, a
hash of the row, and taking the k largest keys draws k documents without replacement in proportion to their weights.
k is the share of good ones among labelled documents, of all documents; `margin` adds standard errors of that share.

Defined cases: null or empty text has weight 0; null doc_id is never labelled; repeated rows are counted and drawn one by one
(equal rows may share a key: then so many of them are drawn that k are kept in all); without labels nothing
is known against any document and all are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._stage import small_side, staged

BUCKETS, SEED = 1 << 16, 11
SMOOTH = 0.5
U = np.uint64


def ngrams(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all words and of all pairs of neighbours."""
    h, doc = w.hashes(), W.segment_ids(w.at)
    one = h >> U(48)
    if len(h) < 2:
        return one.astype(np.int64), doc
    at = np.flatnonzero(doc[1:] == doc[:-1])
    two = W.grams(h, 2)[at] >> U(48)
    return np.concatenate([one, two]).astype(np.int64), np.concatenate([doc, doc[at]])


COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, buf, at in W.chunks(batch.column(0)):
            b, d = ngrams(W.split(buf, at, lower=True))
            raw += np.bincount(b, minlength=BUCKETS)
            target += np.bincount(b[good[i:j][d]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield W.table(COUNTS, at.astype(np.int32), raw[at], target[at])


def log_ratios(marked: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket from (text, good)."""
    got = marked.select("text", "good").mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most BUCKETS rows
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    raw[got["bucket"]] += got["raw"]
    target[got["bucket"]] += got["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> tuple[float, int]:
    """(the k-th largest of column key, how many of the rows equal to it belong to the k largest). Histograms of `bins` counts narrow it down."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    left = k
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return high, left
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        for r in inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect():
            if r["n"] >= left:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
        if low == high:
            return low, left


def resample(docs: DataFrame, good_ids: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, log_weight, gumbel_key, kept for each row of docs. good_ids: distinct doc_id of the target."""
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(small_side(good_ids.select(F.col("doc_id").alias("of"), F.lit(True).alias("good"))), F.col("doc_id") == F.col("of"), "left").drop("of").withColumn("good", F.coalesce("good", F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(marked))

    def run(batches):
        for batch in batches:
            for i, j, buf, at in W.chunks(batch.column(1)):
                w = W.split(buf, at, lower=True)
                b, d = ngrams(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.counts), pa.array(np.bincount(d, shared.value[b], j - i).astype(float)), batch.column(2).slice(i, j - i)], names=["doc_id", "n_words", "log_weight", "turn"])

    turn = F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(F.col("doc_id").cast("long"), "text", turn.alias("turn")).mapInArrow(run, "doc_id long, n_words long, log_weight double, turn long")
    uniform = (F.pmod("turn", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = staged(rows.select("doc_id", "n_words", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key")), "weights")
    n = rows.count()
    k = min(n, round(share * n))
    if k in (0, n):
        return rows.select("doc_id", "n_words", "log_weight", F.col("key").alias("gumbel_key"), F.lit(k > 0).alias("kept"))
    edge, room = kth_largest(rows, k)
    ties = rows.where(F.col("key") == edge)
    if ties.count() == room:
        return rows.select("doc_id", "n_words", "log_weight", F.col("key").alias("gumbel_key"), (F.col("key") >= edge).alias("kept"))
    # Equal keys at the edge: rows of one doc_id and text, or a hash collision.
    ties = ties.withColumn("kept", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")) <= room)
    out = rows.where(F.col("key") != edge).withColumn("kept", F.col("key") > edge).unionByName(ties)
    return out.select("doc_id", "n_words", "log_weight", F.col("key").alias("gumbel_key"), "kept")


def good_share(labels: DataFrame, margin: float = 0.0) -> float:
    """The share of good ones among labels (quality 0 or 1), and margin standard errors of it; 1 without labels."""
    good, known = labels.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
    share = good / known if known else 1.0
    return min(1.0, share + margin * (share * (1 - share) / max(1, known)) ** 0.5)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and quality is not null")
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1").select("doc_id").distinct(), good_share(labels))
