"""Exact removal of long repeated word sequences, by De Bruijn compaction with source coordinates.

An edge is a window of SPAN words; its nodes are the first and the last SPAN - 1 of them. In each text, consecutive
windows that share their minimiser (the ANCHOR words of least hash inside the window, the leftmost on ties) form a path, so equal
windows always lie in paths of equal minimiser. Where all paths of a minimiser have the same content, it does not branch: a
path is one compacted piece. Where contents differ, only one path of each content, its earliest, is taken apart into windows,
whose 128-bit hashes are grouped; a window is repeated if two such paths hold it or if the content itself is repeated. Each piece
and each window has a source: the coordinate (doc_id, place) of its earliest occurrence; every other occurrence is a repeat.

Repeated pieces and repeated windows are the edges of the graph, so all places where it branches are in it. Joins on end nodes find
the nodes with one way in and one way out; edges that meet in such a node and follow each other at their sources compact to one path
with one source. Every occurrence is a stretch of such paths: a piece or a window of its edge's, a repeated content of those that its
earliest path runs through. Stretches of one path at one distance from it merge to a span, so a long copy is one row. Each span is
verified: a BLAKE2 digest of its words must equal that of the words at its source coordinates. Words of verified spans are removed.
(A node inside a piece counts as having one way in and out. Another way through it takes minimisers that are smaller on both of its
sides; spans are then cut at other places, and the words removed are the same.)

Groups are aggregated before they are shuffled, and what is joined back to a hot piece is one staged row, so Spark can split the other side.

Defined cases: null text has no words; rows without doc_id are compared with nothing and come back whole; rows that
repeat a doc_id are one document with the same text and each comes back (of different texts under one doc_id, equal
coordinates count as one); of equal windows in one document, the earliest start keeps its
words; texts below SPAN words are kept; an empty table gives an empty result; other columns are ignored but for those asked for, which come back
as kept_<name> where they would clash.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _words as W
from ._stage import forget, small_side, staged

SPAN, ANCHOR = 20, 8
U = np.uint64
#: Runs of words that may be broadcast with their texts, 8 bytes each; digests of spans, about 60 bytes each.
RUN_LIMIT, SPAN_LIMIT = 2_000_000, 5_000
#: Repeated minimisers that may be broadcast.
SEEN_LIMIT = 20_000
#: Runs of one text that are handled in one row.
PER_ROW = 1000


def leftmost_minima(v: np.ndarray, width: int) -> np.ndarray:
    """For each full window of width values, the position of the least one, the first on ties."""
    at, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        less = v[step:] < v[:-step]
        at, v = np.where(less, at[step:], at[:-step]), np.where(less, v[step:], v[:-step])
        have += step
    return at


def paths(w: W.Words, span: int, anchor: int, nodes: bool):
    """(document, minimiser hash, content hash, first window, last window, first node, last node) of each path; windows count from the text's start."""
    words = w.hashes()
    n, doc = len(words), W.segment_ids(w.at)
    if n < span:
        return (np.zeros(0, np.int64),) * 7
    grams = W.grams(words, anchor)
    low = leftmost_minima(grams, span - anchor + 1)
    ok = doc[: n - span + 1] == doc[span - 1 :]
    begins, ends = ok.copy(), ok.copy()
    same = ok[1:] & ok[:-1] & (low[1:] == low[:-1])
    begins[1:] &= ~same
    ends[:-1] &= ~same
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    # the windows of a path, each with its distance from the minimiser
    each = W.grams(w.hashes(1), span, 1)
    each = W.mix(each + (low - np.arange(len(low))).astype(U) * U(0x9E3779B97F4A7C15))
    sums = W.cumulative(each)
    content = W.mix(sums[b + 1] - sums[a])
    base = w.at[doc[a]]
    s = t = a
    if nodes:
        node = W.grams(words, span - 1)
        s, t = node[a], node[b + 1]
    return doc[a], grams[low[a]], content, a - base, b - base, s, t


def _occurrences(span: int, anchor: int, whole: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, buf, at in W.chunks(batch.column(1)):
                d, h, c, a, b, s, t = paths(W.split(buf, at), span, anchor, whole)
                if len(d):
                    more = {"a": a.astype(np.int32), "b": b.astype(np.int32), "s": W.signed(s), "t": W.signed(t)} if whole else {}
                    yield pa.RecordBatch.from_pydict({"h": W.signed(h), "content": W.signed(c), "doc_id": ids[i:j][d]} | more)

    return run


def _runs(batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the column runs of the rows i to j; rows count from i. A run is start << 32 | end."""
    lists = batch.column(2).slice(i, j - i)
    flat, per = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(j - i), per), flat >> 32, flat & 0xFFFF_FFFF


def _windows(span: int):
    """The windows of the given runs, each with a 128-bit hash, its nodes and the start of its run. The end of a run is twice that, plus 1 for a content that is repeated."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, buf, at in W.chunks(batch.column(1)):
                w = W.split(buf, at)
                one, two, node = W.grams(w.hashes(), span), W.grams(w.hashes(1), span, 1), W.grams(w.hashes(), span - 1)
                d, a, b = _runs(batch, i, j)
                again, b = b & 1, np.minimum(b >> 1, w.counts[d] - span)
                keep = b >= a
                a, b, d, again = a[keep], b[keep], d[keep], again[keep]
                n = b - a + 1
                s = np.repeat(a - W.cumulative(n)[:-1], n) + np.arange(int(n.sum()))
                d = np.repeat(d, n)
                g = s + w.at[d]
                if len(g):
                    more = {"s": W.signed(node[g]), "t": W.signed(node[g + 1]), "run": np.repeat(a, n).astype(np.int32), "again": np.repeat(again, n).astype(np.int32)}
                    yield pa.RecordBatch.from_pydict({"h": W.signed(one[g]), "g": W.signed(two[g]), "doc_id": ids[i:j][d], "a": s.astype(np.int32)} | more)

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(batches):
    """A digest of the words of each run."""
    for batch in batches:
        raw, at = W.utf8(batch.column(1))
        raw = raw.tobytes()
        row, start, end = _runs(batch, 0, batch.num_rows)
        ids, out, last, words = batch.column(0).to_numpy()[row], [], -1, []
        for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            if r != last:
                last, words = r, raw[at[r] : at[r + 1]].split()
            out.append(_digest(words[a:b]))
        yield pa.RecordBatch.from_pydict({"source": pa.array(ids, pa.int64()), "at": pa.array(start, pa.int32()), "to": pa.array(end, pa.int32()), "digest": pa.array(out, pa.binary())})


def _in_texts(known: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, text, runs of the texts that have any, in rows of about PER_ROW runs; runs: doc_id, start, end."""
    runs = staged(runs.select("doc_id", (F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")).alias("run")).distinct(), "runs")
    many = runs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > PER_ROW)
    part = F.pmod(F.xxhash64("run"), F.coalesce(F.ceil(F.col("n") / PER_ROW), F.lit(1)))
    own = runs.join(small_side(staged(many, "many")), "doc_id", "left").groupBy("doc_id", part.alias("part")).agg(F.sort_array(F.collect_list("run")).alias("runs"))
    own = F.broadcast(own) if runs.count() <= RUN_LIMIT else own.hint("merge")
    return known.join(own, "doc_id").select("doc_id", "text", "runs")


def _sourced(met: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups by keys, with source, their least doc_id: adds the place of the group's first occurrence as at."""
    place = staged(met.where("doc_id = source").groupBy(*keys).agg(F.min("a").alias("at")), "place")
    return met.join(small_side(place, SEEN_LIMIT), keys)


def _tally(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    return staged(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("doc_id").alias("source")).where(F.col("n") >= least), "tally")


def compact(edges: DataFrame) -> DataFrame:
    """source, at, b, path: each edge with the place where its compacted path begins at its source.

    edges: distinct edges of the graph (source, at, b: last window, s, t: first and last node). Two edges compact if their common
    node has one way in and one way out and the second follows the first at its source.
    """
    only = lambda c, name: staged(edges.groupBy(c).agg(F.count("*").alias("ways")).where("ways = 1").select(F.col(c).alias(name)), "nodes")
    node = staged(only("s", "node").join(only("t", "to"), F.col("node") == F.col("to")).select("node"), "node")
    inner = edges.join(small_side(node), F.col("s") == F.col("node"), "left_semi").select("source", "at").withColumn("inner", F.lit(True))
    marked = edges.select("source", "at", "b").join(small_side(staged(inner, "inner")), ["source", "at"], "left")
    own = Window.partitionBy("source").orderBy("at")  # the edges of one text
    begins = ~F.coalesce("inner", F.lit(False)) | F.coalesce(F.lag("b").over(own) + 1 != F.col("at"), F.lit(True))
    marked = marked.withColumn("begins", begins).withColumn("path", F.max(F.when(F.col("begins"), F.col("at"))).over(own))
    return staged(marked.select("source", "at", "b", "path"), "compact")


def repeats(known: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, straight, again, single) of texts (doc_id, text).

    edges: what repeats, once each, for compact(). straight: occurrences of pieces (doc_id, a, b, source, at). single: windows taken apart (also run,
    again: where the path they are of begins, and whether its content is repeated). again: occurrences of such contents, where source and at are the earliest's.
    """
    seen = known.mapInArrow(_occurrences(span, anchor, False), "h long, content long, doc_id long")
    seen = seen.groupBy("h").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("doc_id").alias("source")).where("n > 1")
    seen = staged(seen.select("h", (F.col("low") != F.col("high")).alias("branches"), "source"), "seen")
    placed = known.mapInArrow(_occurrences(span, anchor, True), "h long, content long, doc_id long, a int, b int, s long, t long")
    found = staged(placed.join(small_side(seen, SEEN_LIMIT), "h"), "paths")
    itself = (F.col("doc_id") == F.col("source")) & (F.col("a") == F.col("at"))
    straight = staged(_sourced(found.where("not branches"), ["h"]).drop("h", "content", "branches"), "straight")
    branching = found.where("branches").drop("branches", "source", "s", "t")
    contents = _tally(branching, ["h", "content"], 1)
    again = branching.join(small_side(contents.where("n > 1").drop("n"), SEEN_LIMIT), ["h", "content"])
    again = staged(_sourced(staged(again, "again"), ["h", "content"]).drop("h", "content"), "again")

    # The earliest path of each content is taken apart where its minimiser branches.
    alone = branching.join(small_side(contents.where("n = 1").select("h", "content"), SEEN_LIMIT), ["h", "content"], "left_semi")
    least = alone.select("doc_id", "a", (2 * F.col("b")).alias("end")).unionByName(again.where(itself).select("doc_id", "a", (2 * F.col("b") + 1).alias("end")))
    windows = _in_texts(known, least.withColumnRenamed("a", "start"))
    windows = staged(windows.mapInArrow(_windows(span), "h long, g long, doc_id long, a int, s long, t long, run int, again int"), "windows")
    tally = windows.groupBy("h", "g").agg((F.count("*") + F.sum("again")).alias("n"), F.min("doc_id").alias("source")).where("n > 1").drop("n")
    single = staged(windows.join(small_side(staged(tally, "tally"), SEEN_LIMIT), ["h", "g"]), "single")
    single = staged(_sourced(single, ["h", "g"]).drop("h", "g").withColumn("b", F.col("a")), "single")
    edge = ["source", "at", "b", "s", "t"]
    edges = straight.where(itself).select(*edge).unionByName(single.where(itself).select(*edge))
    forget(found, windows)
    return staged(edges.distinct(), "edges"), straight, again, single


def repeated_spans(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, spans: array of (start, end, digest): words start to end of the text stand earlier, where they have this digest."""
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    edges, straight, again, windows = repeats(known, span, anchor)
    path = compact(edges).drop("b")
    itself = (F.col("doc_id") == F.col("source")) & (F.col("a") == F.col("at"))
    columns = ["doc_id", "a", "b", "source", "at", "path"]
    longer = straight.where(~itself).join(small_side(path), ["source", "at"]).select(*columns)
    single = staged(windows.join(small_side(path), ["source", "at"]), "single")
    # The stretches of compacted paths in the earliest path of a repeated content; at most as many as it has windows.
    off = F.col("a") - F.col("at")
    stretch = single.where("again = 1").groupBy(F.col("doc_id").alias("first"), "run", "source", off.alias("off"), "path").agg(F.min("a").alias("from"), F.max("a").alias("to"))
    copies = again.where(~itself).select("doc_id", (F.col("a") - F.col("at")).alias("shift"), F.col("source").alias("first"), F.col("at").alias("run"))
    copies = copies.join(small_side(staged(stretch, "stretch")), ["first", "run"])
    copies = copies.select("doc_id", (F.col("from") + F.col("shift")).alias("a"), (F.col("to") + F.col("shift")).alias("b"), "source", (F.col("from") - F.col("off")).alias("at"), "path")
    both = longer.unionByName(copies).unionByName(single.where(~itself).select(*columns))
    # One row for each run of neighbours in a text that lie at one distance from one compacted path.
    own = Window.partitionBy("doc_id", "source", "off", "path").orderBy("a")  # pieces of one text
    both = both.select("doc_id", "a", "b", "source", "path", (F.col("a") - F.col("at")).alias("off"))
    both = both.withColumn("new", (F.col("a") > F.coalesce(F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    both = both.withColumn("run", F.sum("new").over(own)).groupBy("doc_id", "source", "off", "path", "run").agg(F.min("a").alias("start"), (F.max("b") + span).alias("end"))
    spans = staged(both.select("doc_id", "start", "end", "source", (F.col("start") - F.col("off")).alias("at"), (F.col("end") - F.col("off")).alias("to")), "spans")
    forget(straight, again, single, windows)
    sources = _in_texts(known, spans.select(F.col("source").alias("doc_id"), F.col("at").alias("start"), F.col("to").alias("end")))
    digests = staged(sources.mapInArrow(_digests, "source long, at int, to int, digest binary").distinct(), "digests")
    spans = staged(spans.join(small_side(digests, SPAN_LIMIT), ["source", "at", "to"]).select("doc_id", "start", "end", "digest"), "spans")
    own = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "digest")).alias("spans"))  # spans of one text
    return F.broadcast(own) if spans.count() <= SPAN_LIMIT else own.hint("merge")


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words that no verified span covers."""
    gone = bytearray(len(words))
    for x in spans:
        a, b = x["start"], x["end"]
        if _digest(words[a:b]) == x["digest"]:
            gone[a:b] = b"\1" * (b - a)
    return list(compress(words, (not g for g in gone)))


def dedup(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing is removed), then the given columns of docs."""
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)]
    joined = docs.select(F.col("doc_id").cast("long"), "text", *kept).join(repeated_spans(docs, span, anchor), "doc_id", "left")

    def run(batches):
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            raw, at = W.utf8(batch.column("text"))
            raw, spans = raw.tobytes(), batch.column("spans").to_pylist()
            for i in range(batch.num_rows):
                words = raw[at[i] : at[i + 1]].split()
                counts.append(len(words))
                if spans[i]:
                    words = kept_words(words, spans[i])
                removed.append(counts[-1] - len(words))
                text = b" ".join(words)
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode() if removed[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), *(batch.column(f"_c{i}") for i in range(len(columns)))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *(f"_c{i}" for i in range(len(columns)))],
            )

    schema = StructType()
    for name, kind in (("doc_id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept_text", "string")):
        schema.add(name, kind)
    for i, c in enumerate(columns):
        schema.add(f"_c{i}", docs.schema[c].dataType)
    out = joined.mapInArrow(run, schema)
    for i, c in enumerate(columns):
        out = out.withColumnRenamed(f"_c{i}", f"kept_{c}" if c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") else c)
    return out


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
