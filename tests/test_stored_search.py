"""Searches over the stored layout: grams, blocks, best k, and queries as a table, against searches that read everything."""

import random
import re

import pytest

from textloom.functions import wildcard
from textloom.operators import index
from textloom.plans import blocks, qlang, search, table

WORDS = ["alpha", "beta", "gamma", "delta", "heat", "heater", "sheat", "theta", "tetra", "zeta", "a", "eta"]


@pytest.fixture(scope="module")
def docs(spark):
    """Frequent words everywhere, rare ones in a few ranges; sizes differ, so that scores do."""
    rng, rows = random.Random(11), []
    for d in range(1500):
        rare = ["gamma"] * rng.randint(1, 4) if 300 <= d < 330 or d in (7, 1400) else ["delta"] if 310 <= d < 600 else []
        words = rng.choices(["alpha", "beta"], k=rng.randint(1, 3)) + rare + rng.choices(WORDS[4:], k=rng.randint(0, 2) if d % 97 else 0) + ["pad"] * rng.randint(0, 30 if d % 211 else 0)
        rng.shuffle(words)
        rows.append((d * 3 - 900, " ".join(words)))
    return spark.createDataFrame([*rows, (None, "gamma without id"), (10_000, ""), (10_001, None)], "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path, old = str(tmp_path_factory.mktemp("index")), (index.BLOCKS, index.BLOCK_DOCS)
    index.BLOCKS, index.BLOCK_DOCS = 128, 16
    try:
        index.build(docs).write(path)
    finally:
        index.BLOCKS, index.BLOCK_DOCS = old
    return index.Index.read(spark, path)


@pytest.fixture(scope="module")
def plain(docs):
    i = index.build(docs)
    i.postings = i.postings.cache()
    return i


ASKED = [
    "gamma", "alpha beta", "gamma AND delta", "(gamma AND alpha) OR delta", '"alpha beta"', '"gamma delta alpha"', "he*", "*eta", "t*a", "*", "*e*", '"al* bet*"', '"*eta alpha be*"',
    "nothing", "gamma AND nothing", '"gamma nothing"', "", "the OR ()", "alpha alpha gamma", '"h*"',
]


def rows(found):
    return sorted((r.qid, r.query, r.qtype, r.rank, r.doc_id if r.doc_id is not None else -1e9, r.score) for r in found.collect())


def test_stored_index_gives_the_same(stored, plain):
    asked = list(enumerate(ASKED))
    for strict in (False, True):
        want = rows(search.search(plain, asked, ["the"], strict=strict))
        assert rows(search.search(stored, asked, ["the"], strict=strict)) == want
    assert len({w[0] for w in want}) >= 13


def test_queries_as_a_table(spark, stored, plain, monkeypatch):
    asked = list(enumerate(ASKED))
    frame = spark.createDataFrame(asked + [(99, None)], "qid long, query string")
    for strict in (False, True):
        want = rows(search.search(plain, asked, ["the"], strict=strict))
        assert rows(table.search_table(stored, frame, ["the"], strict)) == want
    assert rows(table.search_table(plain, frame, ["the"], k=3)) == rows(search.search(plain, asked, ["the"], k=3))
    monkeypatch.setattr(table, "BROADCAST_ROWS", 0)  # by an exchange
    assert rows(table.search_table(stored, frame, ["the"], strict=True)) == want


def test_table_of_large_boolean_queries(spark, plain):
    """Too many products for bits: decided by the program."""
    text = " AND ".join(f"({w} OR q{i})" for i, w in enumerate(WORDS[:8]))
    long = "gamma OR (" + " AND ".join(f"w{i}" for i in range(70)) + ")"
    assert qlang.products(qlang.parse(text).tree) is None and qlang.products(qlang.parse(long).tree) is None
    asked = [(1, text), (2, long), (3, f"({text}) OR (gamma AND beta) OR the")]
    assert rows(table.search_table(plain, spark.createDataFrame(asked, "qid long, query string"))) == rows(search.search(plain, asked))


def test_no_query_text_in_the_plan(spark, plain):
    frame = spark.range(3000).selectExpr("id AS qid", "concat('alpha uniqueword', id) AS query")
    found = table.search_table(plain, frame, k=2)
    assert "uniqueword1" not in found._jdf.queryExecution().toString()
    assert found.count() == 6000


@pytest.mark.parametrize("k", [1, 3, 10, 40, 5000])
def test_best_k_reads_fewer_blocks(stored, plain, k):
    asked = [(1, "alpha gamma"), (2, "gamma"), (3, "(gamma AND alpha) OR delta"), (4, "alpha")]
    want = rows(search.search(plain, asked, k=k))
    assert rows(search.search(stored, asked, k=k)) == want
    report, words = [], [(i, p.weights, qlang.products(p.tree) if p.tree else [frozenset()]) for i, q in asked for p in [qlang.parse(q)]]
    blocks.best(stored, words, k, lambda some, ranges: search.word_batch(stored, some, ranges), report)
    skipped = {i: may - read for i, may, read in report}
    if k <= 10:
        assert skipped[1] > 10 and skipped[2] >= 0
    if k == 5000:
        assert not any(skipped.values())


def test_words_together_are_read_where_they_meet(stored):
    ranges = blocks.needed(stored, [(1, {"gamma": 0.5, "delta": 0.5}, [frozenset(["gamma", "delta"])])])
    assert set(ranges) == {"gamma", "delta"} and all(0 <= a <= z < 100 for a, z in ranges["delta"])  # ids 30 to 90, of 0 to 900
    plan = stored.of(["gamma", "delta"], ranges)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: .*doc_id", plan)
    assert blocks.needed(stored, [(1, {"alpha": 1.0, "zz": 1.0}, [frozenset(["alpha", "zz"])])]) == {"alpha": [], "zz": []}


def test_ranges():
    assert blocks.joined([(5, 6), (1, 2), (100, 120), (8, 9)], 2) == [(1, 9), (100, 120)]
    assert blocks.joined([], 2) == [] and blocks.joined([(3, 4)], 1) == [(3, 4)]
    held = {"a": {0: (1, 5, 9, 0.5), 1: (1, 10, 12, 0.1)}, "b": {0: (1, 8, 9, 0.5), 1: (1, 13, 14, 0.5)}}
    assert blocks.meeting(held, frozenset("ab")) == {0: (8, 9)}
    assert blocks.possible(held, {"a", "b"}, [frozenset()]) == {0: (5, 9), 1: (10, 14)}


def test_grams_reach_the_scan(stored):
    found = search.expansions(stored, "*eta")
    assert sorted(r.term for r in found.collect()) == ["beta", "eta", "theta", "zeta"] or {"eta", "zeta"} <= {r.term for r in found.collect()}
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*In\(gram, \[", plan)


def test_grams_of_every_pattern(spark):
    words = "at cat cap atter cip catter ape aper a t".split()
    frame = spark.createDataFrame([(w,) for w in words], "term string")
    grams = {w: {r.gram for r in wildcard.gram_table(frame).where(f"term = '{w}'").collect()} for w in words}
    assert grams["at"] == {"a", "t", "^a", "at", "t$", "^at", "at$"}
    for pattern in ("*", "*t", "c*p", "a*", "*t*", "*a*e", "ca*t*r", "a", "**", "*tte*", "c*tt*r"):
        asked = wildcard.grams_of(pattern)
        fit = {w for w in words if re.search(wildcard.to_regex(pattern), w)}
        assert fit <= {w for w in words if asked <= grams[w]}, pattern


def test_points(spark, stored):
    pairs = spark.createDataFrame([("gamma", 0), ("gamma", 1), ("alpha", None), ("gamma", 0)], "term string, doc_id long")
    assert {(r.term, r.doc_id) for r in blocks.point_lookup(stored, pairs).collect()} == {("gamma", 0)}


def test_strict_wildcard_phrases(spark):
    far = " ".join(["x"] * 30)
    i = index.build(spark.createDataFrame([(1, f"alpha beta {far} gamma"), (2, "alpha beta gamma")], "doc_id long, text string"))
    found = lambda q, strict: {r.doc_id for r in search.search(i, [(1, q)], strict=strict).collect()}
    assert found('"al* beta gamma"', True) == found('"alpha beta gamma"', True) == {2}
    assert found('"al* beta gamma"', False) == {1, 2}


def test_lookups_open_the_files_of_their_terms(spark, docs, tmp_path, monkeypatch):
    from textloom.sources import readers

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small files become one
    try:
        index.build(docs).write(str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    i = index.Index.read(spark, str(tmp_path))
    files = lambda *terms: {f.rpartition("/")[2] for f in i.of(list(terms)).inputFiles()}
    count = lambda *terms: {(r.term, r["count"]) for r in i.of(list(terms)).groupBy("term").count().collect()}
    every = {f.rpartition("/")[2] for f in i.postings.inputFiles()}
    assert len(every) > 2 and files("zeta") < every and files("zeta", "heat") < every and files("0") == set()
    whole = {(r.term, r["count"]) for r in i.postings.groupBy("term").count().collect()}
    assert count("zeta", "alpha", "nothing") == {x for x in whole if x[0] in ("zeta", "alpha")}
    chosen = files("zeta", "heat", "0")
    monkeypatch.setattr(readers, "CHOSEN", 0)
    assert files("zeta", "heat", "0") == chosen and count("zeta") == {x for x in whole if x[0] == "zeta"}
