"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into blocks by a hash of doc_id. How many rows each block sends to each shard is drawn
from the multivariate hypergeometric law, block after block, so that the shards fill up exactly.
Every block permutes its rows and deals them out by its line of the matrix; the rows are exchanged,
and each shard permutes what it has received. All draws come from the seed, and all positions from hashes of
the row, so a task that runs again gives the same rows.

The law is `rows`: shards differ by at most one row. Groups of equal texts play no part in it: copies are placed one by one, as their
own rows, since the counts are drawn over all rows alike. The driver holds the counts of at most BLOCKS blocks; with more rows, blocks are larger.

Defined cases: null text has size 1 and the crc32 of no bytes; null doc_id is a value like any other; rows that repeat
are placed one by one; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import small_side, staged

LAW = "rows"
ROWS_PER_BLOCK, BLOCKS = 250_000, 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A draw for any population: numpy's below its limit, else inversion over the weights next to the mode.

    Neighbouring weights differ by an exact ratio, so no factorials are needed; what lies 40 standard deviations out weighs nothing in doubles.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good + bad else 0
    low, high, n = max(0, draws - bad), min(good, draws), good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    width = 50 + int(40 * math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / (n - 1))))
    up = np.arange(mode, min(high, mode + width), dtype=float)
    down = np.arange(mode, max(low, mode - width), -1, dtype=float)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weight = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """counts[b, s]: rows of block b that go to shard s. Lines sum to blocks, columns to shards."""
    if sum(blocks) != sum(shards):
        raise ValueError("blocks and shards hold different numbers of rows")
    rng, room = np.random.default_rng(seed), list(shards)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for b, n in enumerate(blocks):
        left = sum(room)
        for s in range(len(room)):
            k = n if s == len(room) - 1 else hypergeometric(rng, room[s], left - room[s], n)
            left -= room[s]
            out[b, s], n = k, n - k
        room = [r - k for r, k in zip(room, out[b].tolist(), strict=True)]
    return out


def shard_sizes(rows: int, shards: int, seed: int) -> list[int]:
    """Sizes at most one apart; the seed says which shards hold one row more."""
    sizes = [rows // shards] * shards
    for s in np.random.default_rng(seed + 1).permutation(shards)[: rows % shards]:
        sizes[s] += 1
    return sizes


def uniform_shards(docs: DataFrame, shards: int = 8, seed: int = 20_231, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law does not grow) for each row of docs.

    The driver holds one number for each (block, shard), at most BLOCKS * shards; a block is one task of the local permutations.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shards")
    total = rows.count()
    n_blocks = min(BLOCKS, max(16, -(-total // rows_per_block)))
    key = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("text_crc32"), F.col("size")]
    draw = lambda k: F.xxhash64(F.lit(seed * 8 + k), *key)
    rows = rows.withColumn("block", F.pmod(draw(1), F.lit(n_blocks)).cast("int"))
    sent = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}
    matrix = communication_matrix([sent.get(b, 0) for b in range(n_blocks)], shard_sizes(total, shards, seed), seed)
    ends = spark.createDataFrame([(b, x) for b, x in enumerate(np.cumsum(matrix, axis=1).tolist())], "block int, ends array<bigint>")
    order = Window.partitionBy("block").orderBy(draw(2), "doc_id", "text_crc32", "size")
    dealt = rows.withColumn("turn", F.row_number().over(order)).join(small_side(ends), "block")  # at most BLOCKS rows
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("turn")))).withColumn("part", F.pmod(draw(3), F.lit(n_blocks)).cast("int"))
    dealt = staged(dealt.select("doc_id", "size", "text_crc32", "shard", "part"), "dealt")
    # at most BLOCKS counts for each shard
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "part").orderBy(draw(4), "doc_id", "text_crc32", "size")
    return dealt.withColumn("turn", F.row_number().over(order)).join(small_side(staged(starts, "starts")), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("base") + F.col("turn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return uniform_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
