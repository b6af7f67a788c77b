"""Exact Jaccard self-join of word-shingle sets: a size-aware heavy-light join, and its components.

Texts with equal sets are one class and act once. All tokens of a set are ordered by hash. A partner of a set of n shingles shares
at least need(n) = ceil(3 n / 4) of them, so partners meet among the first tokens of both.

Light sets (at most `boundary` shingles) enumerate all 2-subsets of their first n - need + 2 tokens, at least one of which a
partner has too. Heavy sets put their first LISTED share of tokens into inverted lists, which are scanned; sets near the boundary do
both. The boundary is where the cost is least: 2-subsets are counted by set size, and lists are measured, by their
lengths over all small sets.

A token of one set only joins nothing. Of the listed tokens that are left, partners share at least `common`, so a set
with fewer drops out, and any other needs its rarest ones only. Links are then found in rounds. In each list a hub, the set with
the largest share of tokens that others have too, is compared with all others, which costs one pair for each row however many near
copies of one text there are. Lists whose sets are not yet of one component are scanned, in blocks of bounded size, for all pairs of
different components that pass two exact bounds: a token that no other open set has is in no overlap, and where the parities of two sets'
tokens in a class differ, at least one token is in one of them only. While more pairs pass than there are rows, further hubs come
first. Candidates are verified on the whole sets.

Defined cases: null or empty text has no shingles and links with nothing; fewer words than SHINGLE count as one shingle; rows that
repeat a doc_id each come back, with the largest count and the least component among them; null doc_id has no component and no links;
ties need no rule: the result is unique; an empty table gives an empty result; other columns are ignored but for those asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._components import components
from ._stage import forget, small_side, staged

SHINGLE, LISTED = 5, 0.32
#: Sets up to this size are measured for the boundary; it is chosen among 2 to 3/4 of it.
SMALL = 32
#: Sets in a block of a list while it is scanned, and classes of tokens whose parities bound overlaps.
BLOCK, PARITIES = 1024, 1024
U = np.uint64


def need(n):
    return -(-3 * n // 4)


def listed(n):
    """Tokens that a heavy set puts into lists."""
    return np.minimum(n, np.ceil(LISTED * n).astype(np.int64) + 1)


def subset_keys(n: int) -> int:
    """2-subsets that a light set of n tokens enumerates."""
    return 1 if n == 1 else math.comb(n - need(n) + 2, 2)


def boundary(cost: dict[int, tuple[int, float]]) -> int:
    """The largest light size. cost: sets of each size up to SMALL, and the rows that their lists hold besides the sets themselves."""

    def total(b: int) -> float:
        near = 4 * b // 3
        light = sum(c * subset_keys(n) for n, (c, _) in cost.items() if n <= near)
        return light + sum(c * int(listed(np.int64(n))) + met for n, (c, met) in cost.items() if n > b)

    return min(range(2, 3 * SMALL // 4 + 1), key=lambda b: (total(b), b))


def sets(buf: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens sorted by hash within each text, where each text's tokens begin)."""
    w = W.split(buf, at, lower=True)
    words, n = w.hashes(), w.counts
    per = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), per)
    start = np.arange(int(per.sum())) - W.cumulative(per)[:-1][doc] + w.at[doc]
    h = np.zeros(len(start), U)
    for size in range(1, shingle + 1):
        here = np.minimum(n, shingle)[doc] == size
        if here.any():
            h[here] = W.grams(words, size)[start[here]]
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _digests(batches):
    """doc_id, size, digest of the set, and its first tokens: all of a small set, else the listed ones."""
    for batch in batches:
        for i, j, buf, at in W.chunks(batch.column(1)):
            h, begin = sets(buf, at)
            a, b = W.cumulative(W.mix(h + U(0x51ED270B9A3F8E21))), W.cumulative(W.mix(h ^ U(0xC2B2AE3D27D4EB4F)))
            n = np.diff(begin)
            doc = np.repeat(np.arange(len(n)), n)
            first = np.where(n <= SMALL, n, listed(n))
            kept = np.arange(len(h)) - begin[:-1][doc] < first[doc]
            tokens = pa.ListArray.from_arrays(pa.array(W.cumulative(first), pa.int32()), pa.array(W.signed(h[kept])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int32)), *(pa.array(W.signed(x[begin[1:]] - x[begin[:-1]])) for x in (a, b)), tokens], names=["doc_id", "n", "d1", "d2", "tokens"])


def _whole(batches):
    for batch in batches:
        for i, j, buf, at in W.chunks(batch.column(1)):
            h, begin = sets(buf, at)
            raw, b = h.tobytes(), (begin * 8).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([raw[x:y] for x, y in zip(b[:-1], b[1:], strict=True)], pa.binary())], names=["doc_id", "tokens"])


def _tokens(batches):
    """Each token of whole sets as a row."""
    for batch in batches:
        raw = batch.column(1)
        per = np.array([len(x) // 8 if x is not None else 0 for x in raw.to_pylist()], np.int64)
        ids = np.repeat(batch.column(0).to_numpy(), per)
        flat = np.frombuffer(b"".join(raw.to_pylist()), np.int64)
        for k in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(flat[k : k + 100_000])], names=["doc_id", "token"])


def _verify(batches):
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        ok = np.zeros(batch.num_rows, bool)
        for r in range(batch.num_rows):
            s, t = (np.frombuffer(v[r].as_buffer(), U) for v in (x, y))
            if len(s) > len(t):
                s, t = t, s
            common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0
            ok[r] = common > 0 and 100 * common >= 75 * (len(s) + len(t) - common)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])


def _links(whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. a is the side that recurs: its sets are joined last, so they travel once a pair."""
    side = lambda c, name: whole.select(F.col("doc_id").alias(c), F.col("tokens").alias(name))
    both = pairs.join(side("b", "t"), "b").join(side("a", "s"), "a").select("a", "b", "s", "t")
    return staged(both.mapInArrow(_verify, "a long, b long").distinct(), "links")


def _fits(n, m):
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


def _common(n: Column) -> Column:
    """Listed tokens that a set of n shares at least with any partner: what LISTED exceeds a quarter by, of the smallest partner."""
    return F.ceil(n * F.lit(0.75 * (LISTED - 0.25)) + 1)


def _keys(limit: int) -> Column:
    """The keys of a set (n, tokens) by the heavy-light rule. The lowest bit marks a 2-subset."""
    near, n, token = 4 * limit // 3, F.col("n"), lambda i: F.get("tokens", i)
    last = n - F.ceil(n * 0.75).cast("int") + 1  # place of the last token of the first n - need + 2
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), last), lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.xxhash64(token(i), token(k)))))
    light = F.when(n == 1, F.array(F.xxhash64(token(0)))).when(n <= near, pairs).otherwise(F.array().cast("array<bigint>"))
    heavy = F.when(n > limit, F.slice("tokens", 1, F.least(n, F.ceil(n * LISTED).cast("int") + 1))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.transform(light, lambda x: x.bitwiseOR(1)), F.transform(heavy, lambda x: x.bitwiseAND(-2)))


def _measured(once: DataFrame) -> dict[int, tuple[int, float]]:
    """For each size up to SMALL: sets, and rows of other small sets that their listed tokens meet. At most SMALL rows."""
    small = once.where(F.col("n") <= SMALL)
    each = small.select("n", F.explode(F.slice("tokens", 1, F.least(F.col("n"), F.ceil(F.col("n") * LISTED).cast("int") + 1))).alias("t")).groupBy("t", "n").agg(F.count("*").alias("c"))
    df = each.groupBy("t").agg(F.sum("c").alias("df"))
    met = {r[0]: float(r[1]) for r in each.join(df, "t").groupBy("n").agg(F.sum(F.col("c") * (F.col("df") - 1))).collect()}
    return {r[0]: (r[1], met.get(r[0], 0.0)) for r in small.groupBy("n").count().collect()}


def _lists(once: DataFrame, limit: int) -> DataFrame:
    """key, doc_id, n, share: the rows of all lists by which partners are sure to meet."""
    keys = once.select("doc_id", F.explode(_keys(limit)).alias("key"))
    tally = keys.groupBy("key").agg(F.count("*").alias("df"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("df > 1")
    tally = staged(tally, "tally")
    # A key of two sets has both in its row; longer lists are read from the sets again.
    two = tally.where("df = 2").select("key", "df", F.explode(F.array("low", "high")).alias("doc_id"))
    more = keys.join(small_side(tally.where("df > 2").select("key", "df")), "key").select("key", "df", "doc_id")
    own = two.unionByName(more).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("l"))  # keys of one text
    own = own.join(once.select("doc_id", "n"), "doc_id")
    is_light = lambda x: x["key"].bitwiseAND(1) == 1
    heavy = F.filter("l", lambda x: ~is_light(x))
    rarest = F.slice(heavy, 1, F.greatest(F.lit(0), F.size(heavy) - _common(F.col("n")).cast("int") + 1))
    kept = F.transform(F.concat(F.filter("l", is_light), rarest), lambda x: x["key"])
    share = F.size("l") / F.col("n")
    rows = staged(own.select("doc_id", "n", share.alias("share"), F.explode(kept).alias("key")), "rows")
    again = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    out = staged(rows.join(small_side(staged(again, "again")), "key", "left_semi"), "lists")
    forget(tally, rows)
    return out


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """(a: hub, b) for each row (key, doc_id, n, share, label) of a list and its hub, where labels differ and sizes fit."""
    hub = rows.groupBy("key").agg(F.max_by(F.struct("doc_id", "n", "label"), F.struct("share", -F.col("doc_id"))).alias("hub"))
    met = rows.join(small_side(staged(hub, "hubs")), "key").where((F.col("hub.label") != F.col("label")) & _fits(F.col("n"), F.col("hub.n")))
    return met.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with the label of each set's component so far, of the lists with more than one label."""
    labels = components(links).withColumnRenamed("node", "doc_id")
    at = rows.drop("label").join(small_side(labels), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    at = staged(at, "labelled")
    mixed = at.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return staged(at.join(small_side(staged(mixed, "mixed")), "key", "left_semi"), "open")


def _capped(whole: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with cap, the number of tokens of the set that another set of these rows has too, and the parities of those
    tokens by PARITIES classes. Both bound overlaps. Rows without any possible partner go."""
    ids = staged(rows.select("doc_id").distinct(), "ids")
    tokens = whole.join(small_side(ids), "doc_id", "left_semi").mapInArrow(_tokens, "doc_id long, token long")
    seen = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("df > 1")
    seen = staged(seen, "seen")
    two = seen.where("df = 2").select("token", F.explode(F.array("low", "high")).alias("doc_id"))
    more = tokens.join(small_side(seen.where("df > 2").select("token")), "token").select("token", "doc_id")
    bit, word = F.expr("shiftleft(1L, cast(token & 63 as int))"), F.expr(f"(token >> 6) & {PARITIES // 64 - 1}")
    parities = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(PARITIES // 64)]
    cap = two.unionByName(more).groupBy("doc_id").agg(F.count("*").alias("cap"), *parities)
    cap = staged(cap.select("doc_id", "cap", F.array(*[f"p{k}" for k in range(PARITIES // 64)]).alias("parity")), "cap")
    out = rows.drop("cap", "parity").join(small_side(cap, 100_000), "doc_id").where(4 * F.col("cap") >= 3 * F.col("n"))
    out = staged(out, "open")
    forget(seen)
    return out


def _scan(batches):
    """Pairs of different labels in two blocks of a list that the exact bounds let through."""
    for batch in batches:
        for q, m in zip(batch.column(0), batch.column(1), strict=True):
            (x, nx, cx, lx), (y, ny, cy, ly) = ([side.values.field(k).to_numpy() for k in ("doc_id", "n", "cap", "label")] for side in (q, m))
            px, py = (np.asarray(side.values.field("parity").flatten().to_numpy()).view(U).reshape(len(side.values), -1) for side in (q, m))
            for i in range(0, len(x), 128):
                a = slice(i, i + 128)
                small = np.minimum(cx[a, None], cy[None])
                ok = 7 * small >= 3 * (nx[a, None] + ny[None])
                ok &= (lx[a, None] != ly[None]) & (4 * np.minimum(nx[a, None], ny[None]) >= 3 * np.maximum(nx[a, None], ny[None]))
                r, c = np.nonzero(ok)
                r += i
                for k in range(0, len(r), 20_000):
                    u, v = r[k : k + 20_000], c[k : k + 20_000]
                    # Tokens of one side only: those no other set has, and one at least where parities differ.
                    apart = nx[u] - cx[u] + ny[v] - cy[v] + np.bitwise_count(px[u] ^ py[v]).sum(axis=1)
                    near = 7 * apart <= nx[u] + ny[v]
                    if near.any():
                        u, v = x[u[near]], y[v[near]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of different labels within the lists of rows that may be links. One side is outside the list's largest component."""
    size = rows.groupBy("key", "label").agg(F.count("*").alias("size"))
    main = size.groupBy("key").agg(F.max(F.struct("size", "label")).alias("m"), F.sum("size").alias("all"))
    main = main.select("key", F.col("m.label").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("m.size")) / BLOCK).cast("int").alias("others"))
    at = rows.join(small_side(staged(main.where("others > 0"), "main")), "key")
    member = F.struct(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "n", "cap", "label")], "parity")
    part = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.col(n))).cast("int")  # noqa: E731  blocks of about BLOCK sets
    q = at.where("label <> main").groupBy("key", part("others").alias("qb"), "blocks").agg(F.collect_list(member).alias("q"))
    q = q.withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    m = at.groupBy("key", part("blocks").alias("mb")).agg(F.collect_list(member).alias("m"))
    return staged(q.join(m, ["key", "mb"]).select("q", "m").mapInArrow(_scan, "a long, b long").distinct(), "pairs")


def join_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, n, class_id of each row with a set; links: a, b between classes, enough of them for all components)."""
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    digests = staged(known.mapInArrow(_digests, "doc_id long, n int, d1 long, d2 long, tokens array<long>").where("n > 0"), "digests")
    classes = staged(digests.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), "classes")
    members = staged(digests.drop("tokens").join(classes.hint("merge"), ["n", "d1", "d2"]).select("doc_id", "n", "class_id"), "members")
    # Only one text of each class acts: its id stands in this list of single numbers.
    acting = staged(members.where("doc_id = class_id").select("doc_id").distinct(), "acting")
    once = digests.join(small_side(acting), "doc_id", "left_semi").select("doc_id", "n", "tokens")
    rows = _lists(once, boundary(_measured(once)))
    ids = staged(rows.select("doc_id").distinct(), "ids")
    whole = staged(known.join(small_side(ids), "doc_id", "left_semi").mapInArrow(_whole, "doc_id long, tokens binary"), "sets")
    forget(digests, classes)
    links = _links(whole, _hub_pairs(rows.withColumn("label", F.col("doc_id"))))
    while True:
        rows = _capped(whole, _labelled(rows, links))
        pairs = _all_pairs(rows)
        # More candidates than rows: whole groups are open still, so hubs go on while they find links.
        if pairs.count() > 4 * rows.count() and not (found := _links(whole, _hub_pairs(rows))).isEmpty():
            links = staged(links.unionByName(found), "links")
            continue
        return members, staged(links.unionByName(_links(whole, pairs)), "links")


def near_duplicates(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; then the given columns of docs, which may have any names.

    A column that would clash with one of the three comes back as kept_<name>.
    """
    members, links = join_sets(docs)
    labels = components(links)
    at = members.distinct().join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "class_id").alias("component_id"))
    at = at.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    own = ("doc_id", "n_shingles", "component_id")
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)]
    out = docs.select(F.col("doc_id").cast("long"), *kept).join(at, "doc_id", "left")
    back = [F.col(f"_c{i}").alias(f"kept_{c}" if c in own else c) for i, c in enumerate(columns)]
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *back)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
