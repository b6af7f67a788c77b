"""The best k of a table of queries, by shards of the documents, against all matches."""

import numpy as np
import pytest

from textloom.operators import index
from textloom.plans import search, shards, table

WORDS = ["alpha", "beta", "gamma", "delta", "rare", "seldom"]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(WORDS, size=int(rng.integers(1, 6)), p=[0.35, 0.3, 0.2, 0.1, 0.04, 0.01])) for _ in range(600)]
    return index.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def rows(found):
    return sorted((r.qid, r.query, r.qtype, r.rank, r.doc_id, round(r.score, 6)) for r in found.collect())


@pytest.mark.parametrize("k", [1, 4, 70, 5000])
def test_best_of_a_shard_is_that_of_all_matches(k):
    rng = np.random.default_rng(k)
    has = {c: np.flatnonzero(rng.random(900) < share) for c, share in enumerate((0.9, 0.5, 0.2, 0.02))}
    weight = {c: np.round(rng.random(len(d)) ** 3, 1 + c) for c, d in has.items()}  # many ties
    codes = np.concatenate([np.full(len(d), c) for c, d in has.items()])
    shard = shards.Shard(codes, np.concatenate(list(has.values())) * 3, np.concatenate(list(weight.values())))
    for products in ([0], [1], [3], [1, 6], [12], [8, 3], [15], [16], []):
        terms = [(c, 0.4 / (c + 1), 1 << c) for c in range(4)] + [(9, 0.1, 16)]
        score, bits = np.zeros(900), np.zeros(900, int)
        for c, share, bit in terms[:4]:
            score[has[c]] += share * weight[c]
            bits[has[c]] |= bit
        ok = [d for d in range(900) if bits[d] and any(bits[d] & p == p for p in products)]
        want = sorted((-round(score[d], 6), d * 3) for d in ok)[:k]
        docs, found = shard.best(terms, products, k)
        got = sorted((-round(s, 6), d) for d, s in zip(docs.tolist(), found.tolist(), strict=True))
        assert got[:k] == want and len(set(docs.tolist())) == len(docs)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_matches_of_words_are_not_rows_of_queries(spark, small, k, monkeypatch):
    asked = ["alpha", "alpha gamma", "alpha AND beta", "beta OR (rare AND alpha)", "nowhere", "nowhere AND alpha", "rare seldom alpha", "al*", "", '"alpha beta"', "alpha"]
    asked = [(i, text) for i, text in enumerate(asked * 20)]
    met, matched = [], table._matched
    monkeypatch.setattr(table, "_matched", lambda i, words: met.append(words.count()) or matched(i, words))
    monkeypatch.setattr(shards, "SHARD_ROWS", 200)
    monkeypatch.setattr(shards, "SHARD_QUERIES", 3)
    found = table.search_table(small, spark.createDataFrame(asked, "qid long, query string"), k=k)
    once = rows(search.search(small, asked[:10], k=k))
    want = sorted((i, *r[1:]) for i, text in asked for r in once if r[1] == text)
    assert rows(found) == want
    assert met == [3]  # al* and the two words of the phrase, once each
