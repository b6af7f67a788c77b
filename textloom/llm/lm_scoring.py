"""Prediction by partial matching over bytes, and the unigram base score.

Training counts every byte (and the end of each text) behind its ORDER preceding bytes; shorter contexts
follow by summing. The trie holds all of them, whatever their counts.
A symbol costs, from the longest context seen downwards, the escapes of the contexts without it (method C:
distinct / (total + distinct)) and its share in the first that has it; symbols seen in the longer
context are excluded in the shorter one. Below order 0, the symbols never seen share what is left evenly.

The trie stays a table. The cost of a leaf (a context of ORDER bytes and a symbol) depends on the contexts that end in the
same bytes only, so leaves are dealt out by their last SPLIT bytes and costed group by group; the entries of orders
below SPLIT, which the alphabet bounds, go to every task. Costs of the leaves that the texts use most (at most LEAF_LIMIT)
go to every task; occurrences of all other leaves are joined with their costs, so the limit changes no score.

The base counts words exactly. Counts of the most frequent words (at most WORD_LIMIT) go to every task;
occurrences of all other words are joined with their counts by hash.

Defined cases: null text is empty (one end token); null doc_id is trained on and not held out; every input row,
also a repeated one, gives one row; without training texts each symbol costs log10(257) and the base is 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._stage import staged

ORDER, SPLIT, LEAF_LIMIT, WORD_LIMIT = 5, 3, 700_000, 300_000
END, SYMBOLS = 256, 257
END_WORD = -0x5E2D_58D8_B3BC_DEF1  # the key of the end token among the hashes of words
U = np.uint64


def layout(buf: np.ndarray, at: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, symbols, first position of each text): each text is its bytes and the end, behind `order` zero bytes."""
    n = np.diff(at)
    room = n + order + 1
    begin = W.cumulative(room)
    s = np.zeros(int(begin[-1]), U)
    doc = np.repeat(np.arange(len(n)), n)
    s[np.arange(len(buf)) + (begin[:-1] - at[:-1])[doc] + order] = buf
    s[begin[1:] - 1] = END
    context = np.zeros(len(s), U)
    for j in range(1, order + 1):
        context[j:] |= s[:-j] << U(8 * (j - 1))
    real = np.ones(len(s), bool)
    real[(begin[:-1, None] + np.arange(order)).ravel()] = False
    return context[real], s[real], W.cumulative(n + 1)[:-1]


def unique_sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class Tally:
    """Sums by key of one task, merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        if self.held > 3_000_000 and len(self.keys) > 1:
            k, c = unique_sum(self.keys, self.counts)
            self.keys, self.counts, self.held = [k], [c], min(len(k), 2_000_000)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return unique_sum(self.keys, self.counts) if self.keys else (np.zeros(0, U), np.zeros(0, np.int64))


COUNTS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64()), ("uses", pa.int64())])


def _count(batches):
    """Training rows count leaves (kind 0) and words (kind 1) into n; rows to be scored count their leaves into uses."""
    trained, used, words, texts = Tally(), Tally(), Tally(), 0
    for batch in batches:
        training = batch.column(1).to_numpy(zero_copy_only=False)
        texts += int(training.sum())
        for wanted, leaves in ((True, trained), (False, used)):
            for _, _, buf, at in W.chunks(batch.column(0).filter(pa.array(training == wanted))):
                context, symbol, _ = layout(buf, at)
                leaves.add(context << U(9) | symbol)
                if wanted:
                    words.add(W.split(buf, at, lower=True).hashes())
    for kind, uses, tally in ((0, False, trained), (0, True, used), (1, False, words)):
        k, n = tally.result()
        for i in range(0, len(k), 200_000):
            part, c = W.signed(k[i : i + 200_000]), n[i : i + 200_000]
            none = np.zeros(len(part), np.int64)
            yield W.table(COUNTS, np.full(len(part), kind, np.int8), part, none if uses else c, c if uses else none)
    if texts:
        yield W.table(COUNTS, [1], [END_WORD], [texts], [0])


class Index:
    """Positions of 64-bit keys, by open addressing; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = U(size - 1)
        self.slot = np.full(size, -1, np.int32)
        at, left = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + U(1)) & self.mask
        self.held = np.zeros(size, U)
        self.held[self.slot >= 0] = keys[self.slot[self.slot >= 0]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        """High bits of a product, which all bits of the key have a part in."""
        h = keys * U(0x9E3779B97F4A7C15)
        h >>= U(40)
        h &= self.mask
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.slot[at]
        wrong = np.flatnonzero((self.held[at] != keys) & (out >= 0))
        at = at[wrong]
        while len(wrong):
            at = (at + U(1)) & self.mask
            got = self.slot[at]
            out[wrong] = got
            on = (got >= 0) & (self.held[at] != keys[wrong])
            wrong, at = wrong[on], at[on]
        return out


def _tagged(order, context):
    return np.asarray(order, U) << U(60) | np.asarray(context, U) << U(9)


class Model:
    """log10 probabilities from (order, context, symbol, count); each context comes whole and with all its suffixes."""

    def __init__(self, order: np.ndarray, context: np.ndarray, symbol: np.ndarray, count: np.ndarray, top: int = ORDER):
        self.top = top
        context = context.view(U)
        node_key = _tagged(order, context)
        del order, context
        by = np.argsort(node_key, kind="stable")
        node_key, symbol, count = node_key[by], symbol[by].astype(U), count[by].astype(float)
        nodes, first, self_of = np.unique(node_key, return_index=True, return_inverse=True)
        total = np.add.reduceat(count, first) if len(first) else count
        distinct = np.diff(np.r_[first, len(count)]).astype(float)
        self.nodes, self.entries = Index(nodes | U(511)), Index(node_key | symbol)
        self.q0 = int(distinct[0]) if len(nodes) and nodes[0] == 0 else 0
        full = np.where(distinct >= SYMBOLS, 0, distinct)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_count = np.log10(count)
            self.free = self.log_count - np.log10(total + full)[self_of]
            self.escape = np.where(full > 0, np.log10(full / (total + full)), 0)
            # with what the longer context has seen excluded, for each longer context: the suffix's mass left
            o = nodes >> U(60)
            parent_key = np.where(o > 0, (o - (o > 0)) << U(60) | (nodes & ((U(1) << (U(8) * np.maximum(o, U(1)) + U(1))) - U(1)) & ~U(511)), U(0))
            parent = self.nodes.find(parent_key | U(511))
            seen = self.entries.find(parent_key[self_of] | symbol)
            seen_mass = np.bincount(self_of, np.where(seen >= 0, count[np.maximum(seen, 0)], 0), len(nodes)) if len(nodes) else total
            left, more = total[parent] - seen_mass, distinct[parent] - distinct
            more_escape = np.where(distinct[parent] >= SYMBOLS, 0, more)
            self.denominator = np.where(left + more_escape > 0, np.log10(left + more_escape), 0)
            self.escape_excluding = np.where((more_escape > 0) & (left + more_escape > 0), np.log10(more_escape / (left + more_escape)), 0)

    def cost(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbol))
        todo, above = None, np.full(len(symbol), -1, np.int32)
        for k in range(self.top, -1, -1):
            c = context & U((1 << (8 * k)) - 1)
            key = U(k << 60) | c << U(9)
            e = self.entries.find(key | symbol)
            hit = e >= 0
            held = above[hit]
            value = np.where(held < 0, self.free[e[hit]], self.log_count[e[hit]] - self.denominator[held])
            miss = np.flatnonzero(~hit)
            if todo is None:
                out[hit] = value
                todo = miss
            else:
                out[todo[hit]] += value
                todo = todo[miss]
            above, context, symbol = above[miss], context[miss], symbol[miss]
            if not len(todo):
                return out
            node = self.nodes.find(key[miss] | U(511))
            there = node >= 0
            out[todo] += np.where(there, np.where(above < 0, self.escape[np.maximum(node, 0)], self.escape_excluding[above]), 0) if len(self.escape) else 0
            above = np.where(there, node, above)
        out[todo] -= math.log10(max(1, SYMBOLS - self.q0))
        return out


def _least_count(df: DataFrame, column: str, limit: int) -> int:
    """The least count such that at most limit rows reach it, at steps of a twelfth beyond 64; a few hundred numbers go to the driver."""
    c = F.col(column)
    level = F.when(c < 64, c).otherwise(64 + F.floor(8 * (F.log2(c.cast("double")) - 6)))
    room, least = limit, 1 << 62
    for r in df.where(c > 0).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min(column).alias("least")).orderBy(F.desc("least")).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    return least


def _shorter(key: np.ndarray, count: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by the last `order` bytes of the context and the symbol."""
    return unique_sum([key & U((1 << (8 * order + 9)) - 1)], [count])


COSTS = pa.schema([("key", pa.int64()), ("uses", pa.int64()), ("cost", pa.float64())])


def _cost_groups(low: list[tuple[np.ndarray, np.ndarray]], rows: int = 400_000):
    """Costs of leaves sorted by their last SPLIT bytes, about `rows` at a time; a group stays together."""
    split = U((1 << (8 * SPLIT)) - 1)

    def costs(key, n, uses):
        seen = n > 0
        leaves, count = unique_sum([key[seen]], [n[seen]])
        parts = []
        for k, (e, c) in enumerate(low):  # of the low orders, what the groups at hand can meet
            ends = np.unique(key >> U(9) & U((1 << (8 * k)) - 1))
            there = np.isin(e >> U(9), ends)
            parts.append((k, e[there], c[there]))
        parts += [(k, *_shorter(leaves, count, k)) for k in range(SPLIT, ORDER + 1)]
        order = np.concatenate([np.full(len(e), k) for k, e, _ in parts])
        entry, count = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        model = Model(order, entry >> U(9), entry & U(511), count)
        asked = uses > 0
        key, uses = key[asked], uses[asked]
        for i in range(0, len(key), 100_000):
            part = key[i : i + 100_000]
            yield W.table(COSTS, W.signed(part), uses[i : i + 100_000], model.cost(part >> U(9), part & U(511)))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
            if size < rows:
                continue
            key, n, uses = (np.concatenate(x) for x in zip(*held, strict=True))
            key = key.view(U)
            group = key >> U(9) & split
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                yield from costs(key[:whole], n[:whole], uses[:whole])
            held, size = [[W.signed(key[whole:]), n[whole:], uses[whole:]]], len(key) - whole
        if size:
            key, n, uses = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from costs(key.view(U), n, uses)

    return run


class Trie:
    """All leaves seen in training as a table (key, n), and the entries of the orders below SPLIT."""

    def __init__(self, leaves: DataFrame):
        self.leaves = leaves
        entry = F.col("key").bitwiseAND((1 << (8 * (SPLIT - 1) + 9)) - 1)
        low = leaves.where("n > 0").groupBy(entry.alias("e")).agg(F.sum("n").alias("n")).toArrow()
        e, n = (low[c].to_numpy() for c in ("e", "n"))
        self.low = [_shorter(e.view(U), n, k) for k in range(SPLIT)]

    def costs(self, leaves: DataFrame) -> DataFrame:
        """key, uses, cost of the rows of leaves (key, n, uses) with uses; n must be that of the training."""
        ends = F.shiftright("key", 9).bitwiseAND((1 << (8 * SPLIT)) - 1)
        dealt = leaves.withColumn("ends", ends).repartition("ends").sortWithinPartitions("ends").select("key", "n", "uses")
        return dealt.mapInArrow(_cost_groups(self.low), "key long, uses long, cost double")

    def cost(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probabilities of a few symbols behind their contexts."""
        key = W.signed(np.asarray(context, U) << U(9) | np.asarray(symbol, U))
        spark = self.leaves.sparkSession
        asked = spark.createDataFrame([(int(k), 0, 1) for k in np.unique(key)], "key long, n long, uses long")
        found = self.costs(self.leaves.select("key", "n", F.lit(0).cast("long").alias("uses")).unionByName(asked)).collect()
        found = {r.key: r.cost for r in found}
        return np.array([found[int(k)] for k in key])


def train(texts: DataFrame, docs: DataFrame | None = None) -> tuple[DataFrame, Trie, tuple[np.ndarray, np.ndarray], int, int]:
    """(counts by word key, trie, counts of frequent words, tokens, distinct tokens) of the column text; docs are the texts to be scored."""
    rows = texts.select("text", F.lit(True).alias("training"))
    if docs is not None:
        rows = rows.unionByName(docs.select("text", F.lit(False).alias("training")))
    counted = rows.mapInArrow(_count, "kind byte, key long, n long, uses long").groupBy("kind", "key")
    counted = staged(counted.agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")), "counts")
    words = counted.where("kind = 1").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = _least_count(words, "n", WORD_LIMIT)
    frequent = words.where(F.col("n") >= often).toArrow()
    trie = Trie(counted.where("kind = 0").select("key", "n", "uses"))
    return words, trie, (frequent["key"].to_numpy(), frequent["n"].to_numpy()), int(n), int(v)


SCORES = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("rare_leaves", pa.list_(pa.int64()))])


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out. training: text. Both are read whole."""
    spark = docs.sparkSession
    words, trie, (frequent, counts), n, v = train(training, docs)
    costs = staged(trie.costs(trie.leaves), "costs")
    often = _least_count(costs, "uses", LEAF_LIMIT)
    usual = costs.where(F.col("uses") >= often).select("key", "cost").toArrow()
    # At most LEAF_LIMIT leaves and WORD_LIMIT words.
    leaves = Index(usual["key"].to_numpy().view(U)), usual["cost"].to_numpy()
    shared = spark.sparkContext.broadcast((*leaves, Index(frequent.view(U)), np.log10(counts + 1.0)))

    def run(batches):
        leaf_index, leaf_cost, index, log_count = shared.value
        for batch in batches:
            for i, j, buf, at in W.chunks(batch.column(3)):
                context, symbol, first = layout(buf, at)
                key = context << U(9) | symbol
                leaf = leaf_index.find(key)
                held = leaf >= 0
                value = np.add.reduceat(np.where(held, leaf_cost[leaf] if len(leaf_cost) else 0.0, 0.0), first)
                rest = np.r_[0, np.cumsum(np.add.reduceat((~held).astype(np.int64), first))].astype(np.int32)
                rare_leaves = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(W.signed(key[~held]), pa.int64()))
                w = W.split(buf, at, lower=True)
                h = w.hashes()
                got = index.find(h)
                ok = got >= 0
                c = W.cumulative(np.where(ok, log_count[got] if len(log_count) else 0.0, 0.0))
                known = W.cumulative(ok.astype(np.int64))
                rare_at = (w.at - known[w.at]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(W.signed(h[~ok]), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(3)), *(pa.array(x) for x in (w.counts + 1, known[w.at[1:]] - known[w.at[:-1]], c[w.at[1:]] - c[w.at[:-1]], value)), rare, rare_leaves],
                    names=["row", "doc_id", "held_out", *SCORES.names[1:]],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "held_out", "text")
    rows = staged(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, log_counts double, score double, rare array<long>, rare_leaves array<long>"), "scores")
    # The end token is known if there are training texts; its count is the number of those.
    ends = words.where(F.col("key") == END_WORD).agg(F.max("n")).first()[0] or 0
    rare = rows.select("row", F.explode("rare").alias("key")).join(words, "key")
    rare = rare.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    others = rows.select("row", F.explode("rare_leaves").alias("key")).join(costs.where(F.col("uses") < often).select("key", "cost"), "key")
    others = others.groupBy("row").agg(F.sum("cost").alias("rare_cost"))
    known = F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0)) + math.log10(ends + 1)
    return rows.drop("rare", "rare_leaves").join(rare, "row", "left").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_cost", F.lit(0.0))).alias("score"),
    )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    return score(docs, docs.where("not held_out"))
