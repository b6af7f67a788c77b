"""Rows in key order on disk: lookups that open little, batches against a dictionary, merges, and two writers."""

import random

import pytest

from textloom.operators import kv_store
from textloom.operators.kv_store import Store
from textloom.sources import segments

ROW = "key long, payload string"


def frame(spark, rows):
    return spark.createDataFrame(list(rows), ROW)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_lookups_open_one_chunk(spark, tmp_path):
    rows = [(k * 7, f"v{k % 10}") for k in range(1000)]
    store = Store.create(frame(spark, rows), str(tmp_path / "s"), chunk_rows=50)
    assert found(store.rows()) == rows
    one = store.search(350)
    assert found(one) == [(350, "v0")] and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and "EqualTo(key,350)" in plan
    assert found(store.search(351)) == [] and found(store.search(-10**12)) == []
    assert found(store.search_keys(frame(spark, [(7, None), (8, None), (None, None), (6993, None)]).select("key"))) == [(7, "v1"), (6993, "v9")]
    assert found(store.search_values(frame(spark, [(1, "v3"), (1, None), (2, "none")]))) == [r for r in rows if r[1] == "v3"]
    many = frame(spark, [(i, f"v{i}") for i in range(300)])  # too many for the scan to be told
    assert found(store.search_values(many)) == rows
    assert [r.key for r in store.ordered().collect()] == [k for k, _ in rows]


def test_batches_rewrite_what_they_hit(spark, tmp_path):
    store = Store.create(frame(spark, [(k, "a") for k in range(1000)]), str(tmp_path / "s"), chunk_rows=100)
    before = {r.chunk: r.folder for r in store._map().collect()}
    store = store.update(frame(spark, [(150, "b"), (151, "c"), (151, "b"), (5000, "no"), (-1, "no")]))
    after = {r.chunk: r.folder for r in store._map().collect()}
    assert [c for c in after if after[c] != before.get(c)] == [1] and set(after) == set(before)
    assert found(store.search(151)) == [(151, "c")] and store.rows().count() == 1000
    assert found(store.search_values(frame(spark, [(0, "b")]))) == [(150, "b")]
    assert 150 not in {r.key for r in store.search_values(frame(spark, [(0, "a")])).collect()}  # its old entry is stale


def test_random_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kv_store.Store.compact, "__defaults__", (2,))
    rng, path = random.Random(5), str(tmp_path / "s")
    model = {k: "x" for k in range(-5, 20, 3)}
    store, last = Store.create(frame(spark, model.items()), path, chunk_rows=4), max(model)
    for step in range(4):
        given = {rng.randint(-60, 60): rng.choice("xyz") for _ in range(5)}
        free = sorted(rng.choice("pqr") for _ in range(3))
        store = store.insert(frame(spark, [*given.items(), *((None, p) for p in free)]))
        last = max(last, *given)
        model |= given | {last + 1 + i: p for i, p in enumerate(free)}
        last += len(free)
        changes = {rng.randint(-60, 60): None if step == 2 else "new" for _ in range(8)}
        store = store.update(frame(spark, changes.items()))
        model |= {k: v for k, v in changes.items() if k in model}
        assert found(store.rows().na.fill("-")) == sorted((k, v or "-") for k, v in model.items())
        assert found(store.search_values(frame(spark, [(0, "new"), (0, "p")]))) == sorted((k, v) for k, v in model.items() if v in ("new", "p"))
    assert len(store.manifest["folders"]) <= 3
    segments.clean(spark, path, keep=0)
    assert found(Store.open(spark, path).rows().na.fill("-")) == sorted((k, v or "-") for k, v in model.items())


def test_two_writers_and_empty_stores(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store.create(frame(spark, []), path)
    assert store.rows().count() == 0 and found(store.search_values(frame(spark, [(1, "a")]))) == []
    store.insert(frame(spark, [(3, "a"), (3, "b")]))
    with pytest.raises(segments.Conflict):
        store.insert(frame(spark, [(4, "late")]))
    assert found(Store.open(spark, path).rows()) == [(3, "b")]
    with pytest.raises(ValueError, match="no store"):
        Store.open(spark, str(tmp_path / "none"))
