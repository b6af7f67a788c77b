"""Deduplication, joins, decontamination and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import _components, decontamination, ngram_join, substring_dedup

EDGES = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "no id here at all but words"), (None, None)]
SCHEMA = "doc_id long, text string, h long, a int, n int, spans string, component_id long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, "s", 9) for d, t in rows], SCHEMA)


def plain_dedup(rows, span=20):
    first, out = {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            if first.setdefault(k, (d, i)) < (d, i):
                gone[i : i + span] = [True] * span
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_dedup(spark):
    rng, rows = random.Random(5), []
    passage = [rng.choice("abcdef") for _ in range(60)]
    for i in range(200):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            k = rng.randint(0, 30)
            w = w + passage[k : k + rng.randint(15, 40)] + w[:10]
        if i % 7 == 0:
            w += ["z"] * rng.randint(0, 70)
        rows.append((i * 5 - 300, " ".join(w + w if i % 11 == 0 else w)))
    rows += [(5000, "long " * 30_000), (5001, "copy of nothing"), *[(6000 + i, " ".join(f"q{j}" for j in range(45))) for i in range(3)]]
    expected = plain_dedup(rows)
    got = substring_dedup.dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expected
    for r in got:
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_substring_dedup_shuffled_paths(spark, monkeypatch):
    for name in ("RUN_LIMIT", "SPAN_LIMIT", "SEEN_LIMIT"):
        monkeypatch.setattr(substring_dedup, name, -1)
    monkeypatch.setattr(substring_dedup, "PER_ROW", 2)
    rows = [(i, " ".join([f"a{i}"] * (i % 4) + [f"w{j}" for j in range(i % 6, 40)])) for i in range(30)]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, rows)).collect()} == plain_dedup(rows)


def plain_paths(rows, span=20):
    """(source, first window, last window) of each path of the compacted graph of repeated windows."""
    first, count, windows = {}, Counter(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        windows[i] = [tuple(words[a : a + span]) for a in range(len(words) - span + 1)]
        for a, w in enumerate(windows[i]):
            first.setdefault(w, (i, a))
            count[w] += 1
    edges = [w for w in first if count[w] > 1]
    out, into = Counter(w[:-1] for w in edges), Counter(w[1:] for w in edges)
    at, found = {first[w]: w for w in edges}, []
    for i, a in sorted(at):
        before, node = at.get((i, a - 1)), at[i, a][:-1]
        if before and out[node] == into[node] == 1:
            found[-1][2] = a
        else:
            found.append([i, a, a])
    return {tuple(x) for x in found}


def test_compaction(spark):
    """Paths and their ends are those of a plain compacted graph, and the spans lie in them: one for each stretch of a copy in a path."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    x, y, z, p = fresh(70), fresh(45), fresh(33), fresh(20)
    # x in whole, cut short at both ends, in parts that branch off into y and z, and twice in one text; p is one window alone
    shapes = [x, x, x[10:], x[:40] + y, x[:40] + z, y[5:] + x[30:], z + x, x[:35] + fresh(3) + x[35:], p, p, y, x + x[:50], x[3:60], x[3:60]]
    rows = [(n + 1, " ".join(fresh(rng.randrange(0, 30)) + s + fresh(rng.randrange(0, 30)))) for n, s in enumerate(shapes)]
    known = frame(spark, rows).select("doc_id", "text")
    edges = substring_dedup.repeats(known)[0]
    paths = substring_dedup.compact(edges).groupBy("source", "path").agg(F.max("b").alias("b")).collect()
    want = plain_paths(rows)
    assert {(r.source, r.path, r.b) for r in paths} == want
    assert len(paths) == len(want) < edges.count()
    spans = {(r.doc_id, s.start, s.end) for r in substring_dedup.repeated_spans(frame(spark, rows)).collect() for s in r.spans}
    texts = {i: t.split() for i, t in rows}
    inside = [{tuple(texts[i][j : j + 20]) for j in range(a, b + 1)} for i, a, b in want]
    for i, a, b in spans:
        mine = {tuple(texts[i][j : j + 20]) for j in range(a, b - 19)}
        assert any(mine <= p for p in inside)
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.dedup(frame(spark, rows)).collect()} == {(i, n) for i, (_, n, _) in plain_dedup(rows).items()}


def test_substring_dedup_edges(spark):
    same = (9, " ".join(f"w{j}" for j in range(30)))
    rows = EDGES + [same, same, (10, same[1])]
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.dedup(frame(spark, rows)).collect())
    assert got == Counter({(9, 0): 2, (10, 30): 1, (None, 0): 2, **{(d, 0): 1 for d, _ in EDGES if d is not None}})
    assert substring_dedup.dedup(frame(spark, []), columns=("text", "h")).count() == 0


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for d in sorted(sets):
        common = Counter(y for s in sets[d] for y in lists[s])
        for y, k in common.items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[y]) - k):
                a, b = sorted((root(d), root(y)))
                parent[b] = a
        for s in sets[d]:
            lists[s].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def components_of(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}


def test_jaccard_join(spark):
    rng, rows = random.Random(3), []
    base = [f"w{i}" for i in range(100)]
    for i in range(80):  # one large group of near copies: long lists, settled by pivots
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(100)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(rng.choice("abAB") for _ in range(rng.randint(0, 14)))) for i in range(80)]  # light sets
    rows += [(300 + i, " ".join(base[:30] + [f"z{rng.randrange(9999)}" for _ in range(rng.randint(0, 60))])) for i in range(60)]  # a shared passage
    rows += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "word " * 20_000), (505, "word " * 20_001)]
    assert components_of(spark, rows) == plain_components(rows)


def test_jaccard_join_chain(spark):
    """Each text links with the next only; all are one component."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(40)]
    got = components_of(spark, rows)
    assert got == plain_components(rows) and {c for _, c in got.values()} == {0}


def test_jaccard_join_edges(spark):
    rows = EDGES + [(9, "a b c d e f g"), (9, "a b c d e f g"), (8, "A b c d e f g")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 1, 4): 1, (5, 1, 4): 1, (None, 0, None): 2, (9, 3, 8): 2, (8, 3, 8): 1})
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(200, 300 + i) for i in range(50)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.label for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_decontamination(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    items = [(i, text(rng.randint(15, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "short")]
    docs = [(i, text(rng.randint(0, 300))) for i in range(60)]
    planted = {(100 + i, i) for i in range(30)}
    for d, i in sorted(planted):
        cut = rng.randint(0, 150)
        filler = text(300).split()
        body = items[i][1].upper() if i % 4 == 0 else items[i][1]
        docs.append((d, " ".join(filler[:cut]) + " " + body + ".\n" + " ".join(filler[cut:])))
    docs += [(500, None), (501, "")]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == planted
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.leaks(docs.limit(0), bench).count() == 0


def test_slices_change_nothing(spark, monkeypatch):
    """A benchmark searched in slices gives the scores and passages of one searched whole."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))
    items = [(i, text(rng.randint(10, 90))) for i in range(30)] + [(90, " \n"), (91, "")]
    docs = [(i, text(rng.randint(0, 150)) + " " + items[i][1] + " " + text(rng.randint(0, 150))) for i in range(30)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted((r.doc_id, r.item_id, r.passage_start, round(r.score, 5)) for r in decontamination.leaks(docs, bench).collect())
    whole = run()
    monkeypatch.setattr(decontamination, "SLICE", 7)
    assert len(whole) >= 30 and run() == whole


def test_pruning_loses_nothing(spark):
    """Block maxima skip only passages whose exact scores stay below the threshold."""
    import numpy as np
    import pyarrow as pa

    from textloom.llm import _words

    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("ijkl") for _ in range(n))
    index = decontamination.ItemIndex(list(range(25)), [text(rng.randint(3, 30)) for _ in range(25)])
    buf, at = _words.utf8(pa.array([text(rng.randint(0, 400)) for _ in range(20)]))
    w = _words.split(buf, at)
    words = decontamination._core(w)
    got = {(int(d), int(i), s) for d, i, s, _ in index.search(words, w.at, 0.6)}
    want = set()
    for d in range(20):
        x = words[w.at[d] : w.at[d + 1]]
        for s in range(0, max(1, len(x)), index.stride):
            span = set(x[s : s + 2 * index.stride].tolist())
            score = np.zeros(25)
            for t, term in enumerate(index.terms.tolist()):
                if term in span:
                    a, b = index.post[t], index.post[t + 1]
                    score[index.item[a:b]] += index.weight[a:b]
            want |= {(d, int(i), s) for i in np.flatnonzero(score >= 0.6 - 1e-6)}
    assert got == want


@pytest.mark.skipif(not __import__("importlib").util.find_spec("corpus_pipeline"), reason="the pipeline is absent")
def test_pipeline(spark):
    """Each stage against the plain meaning of its operator, on the rows that the stage before kept."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from textloom.llm import bpe, quality_rules
    from textloom.llm._stage import staged

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    stages = dict(p.STAGES)
    one = staged(stages["quality_rules"](spark, docs, sf), "one")
    assert {r.doc_id for r in one.collect()} == kept and one.columns == columns
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = staged(stages["ngram_jaccard_join"](spark, one, sf), "two")
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, c in plain_components(rows).values()}) and two.columns == columns
    rows = [(r.doc_id, r.text) for r in two.collect()]
    expected = plain_dedup(rows)
    three = staged(stages["substring_dedup"](spark, two, sf), "three")
    assert three.columns == columns
    text = dict(rows)
    for r in three.collect():
        n, removed, digest = expected[r.doc_id]
        assert r.text == text[r.doc_id] if not removed else hashlib.sha256(r.text.encode()).hexdigest() == digest
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in three.collect()} == {d for d, (n, removed, _) in expected.items() if not removed or removed < n}
    four = staged(stages["benchmark_decontamination"](spark, three, sf), "four")
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in three.collect() if not any(i in " ".join(r.text.lower().split()) for i in items)}
    assert {r.doc_id for r in four.collect()} == clean and four.columns == columns
    t = Tokenizer.from_file(bpe.vocabulary_path())
    five = stages["bpe_codec"](spark, four, sf).collect()
    text = {r.doc_id: r.text for r in four.collect()}
    assert {r.doc_id: r.ids for r in five} == {d: t.encode(x, add_special_tokens=False).ids for d, x in text.items()}


@pytest.mark.skipif(not __import__("importlib").util.find_spec("corpus_pipeline"), reason="the pipeline is absent")
def test_pipeline_decides_by_row(spark):
    """A leak in a row without doc_id goes; different texts under one doc_id are judged each."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 20)
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(None, f"{one} {item} {two}"), (None, one), (7, one), (7, f"{two} {item}"), (7, two)]
    stages, docs = dict(p.STAGES), spark.createDataFrame(rows, "doc_id long, text string")
    got = stages["benchmark_decontamination"](spark, docs, sf)
    assert Counter(map(tuple, got.collect())) == Counter([rows[1], rows[2], rows[4]]) and got.columns == docs.columns
    rows = [(7, one), (7, two), (7, one), (5, two), (9, one), (None, one)]
    got = stages["ngram_jaccard_join"](spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert Counter(map(tuple, got.collect())) == Counter([(7, one), (5, two), (None, one)]) and got.columns == docs.columns


@pytest.mark.skipif(not __import__("importlib").util.find_spec("corpus_pipeline"), reason="the pipeline is absent")
def test_pipeline_edges(spark):
    """Nulls, blanks, repeats, a long text, and columns named like results, in every stage; empty tables stay empty."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    names = ["n_words", "n_removed", "kept_sha256", "kept_text", "n_shingles", "component_id", "_row", "_id", "doc", "spans", "ids", "n_tokens", "score", "kept", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    long = " ".join(f"u{i}x" for i in range(30_000))
    rows = [(d, t, *names) for d, t in [*EDGES, (9, long), (9, long), (None, long), (20, " ".join(f"v{i}" for i in range(80)))]]
    docs, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    stages = dict(p.STAGES)
    want = {
        "quality_rules": [r for r in rows if len((r[1] or "").split()) >= 50],
        "ngram_jaccard_join": [r for i, r in enumerate(rows) if r[0] is None or r[0] not in (5, 9) or (r[0] == 9 and i == len(EDGES))],
        "substring_dedup": rows,
        "benchmark_decontamination": rows,
    }
    for name, kept in want.items():
        got = stages[name](spark, docs, sf)
        assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(kept), name
        assert stages[name](spark, empty, sf).count() == 0
    got = stages["bpe_codec"](spark, docs, sf)
    assert got.count() == len(rows) and len(set(got.columns)) == len(got.columns) and {"ids", "own_ids", "own_n_tokens"} <= set(got.columns)
    assert stages["bpe_codec"](spark, empty, sf).count() == 0


def test_hash_collisions_change_nothing(spark):
    """Words of many letters in which simple sums cancel are different words."""
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*words, t])), (2, " ".join([*words, u]))]
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.dedup(frame(spark, rows)).collect()} == {(1, 0), (2, 0)}
    rows = [(3, f"{t} one"), (4, f"{u} one")]
    assert components_of(spark, rows) == {3: (1, 3), 4: (1, 4)}


def test_one_passage_in_every_text(spark):
    """A hot passage, whole and cut, amid other words; long copies become few spans."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for d in range(150):
        a, b = (0, 70) if d % 3 else sorted((rng.randrange(30), 40 + rng.randrange(30)))
        rows.append((d, " ".join([f"x{d}y{i}" for i in range(rng.randrange(9))] + passage[a:b] + [f"z{d}y{i}" for i in range(rng.randrange(9))])))
    rows += [(200 + i, " ".join(f"c{j}" for j in range(300))) for i in range(20)]
    got = substring_dedup.dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_dedup(rows)
    spans = {r.doc_id: len(r.spans) for r in substring_dedup.repeated_spans(frame(spark, rows)).collect()}
    assert all(spans[200 + i] == 1 for i in range(1, 20)) and max(spans.values()) <= 8


def test_unverified_spans_stay():
    """Words that differ from those at the source are kept, whatever hashes have said."""
    words = [b"a", b"b", b"c"]
    right, wrong = substring_dedup._digest(words[:2]), substring_dedup._digest([b"a", b"x"])
    assert substring_dedup.kept_words(words, [{"start": 0, "end": 2, "digest": wrong}]) == words
    assert substring_dedup.kept_words(words, [{"start": 0, "end": 2, "digest": right}]) == [b"c"]


def test_boundary_follows_the_lists():
    """Long lists make 2-subsets cheaper for larger sets; lists of one make them dearer."""
    sizes = range(1, ngram_join.SMALL + 1)
    short = ngram_join.boundary({n: (100, 0.0) for n in sizes})
    long = ngram_join.boundary({n: (100, 100 * 500.0) for n in sizes})
    assert short < long <= 3 * ngram_join.SMALL // 4


def test_jaccard_join_by_hub_rounds(spark, monkeypatch):
    """Where hubs miss, more rounds and the scan of blocks find the rest; limits change nothing."""
    rng, rows = random.Random(8), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)] + [f"all{i}" for i in range(25)]
        for i in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(60)] = f"x{rng.randrange(99)}"
            rows.append((1000 * g + i, " ".join(w)))
    expected = plain_components(rows)
    assert components_of(spark, rows) == expected
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "_hub_pairs", lambda rows: rows.select(rows.doc_id.alias("a"), rows.doc_id.alias("b")).limit(0))
    assert components_of(spark, rows) == expected


def test_a_long_item_changes_nothing_for_short_ones(spark):
    """Passages of short items keep their length beside an item of thousands of words, which is found too."""
    rng = random.Random(8)
    text = lambda n, letters="abcdefghij": " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    short, long = [text(30) for _ in range(20)], text(5000, "klmnopqrst")
    docs = frame(spark, [(i, f"{text(400)} {short[i]} {text(400)}" if i % 2 else text(600)) for i in range(20)] + [(50, text(100) + " " + long + " " + text(50))])
    run = lambda items: {(r.doc_id, r.item_id, r.passage_start, r.question_overlap, r.answer_overlap) for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    alone = run(list(enumerate(short)))
    assert {(d, i) for d, i, *_ in alone} == {(i, i) for i in range(1, 20, 2)}
    both = run([*enumerate(short), (99, long)])
    assert {x for x in both if x[1] != 99} == alone and {x[0] for x in both if x[1] == 99} == {50}


def test_decontamination_edges(spark):
    """Null and repeated doc_ids, items of equal text, marks and case, and a text of 60,000 words with an item at its end."""
    item = " ".join(f"q{i}" for i in range(30)) + " answer " + " ".join(f"a{i}" for i in range(14))
    filler = " ".join(f"f{i}" for i in range(60_000))
    items = [(1, item), (2, item), (3, "  "), (None, item), (4, "one two")]
    docs = [(None, f"x {item.upper()}!"), (7, item), (7, item), (8, f"{filler} {item}"), (9, filler), (10, None), (11, "one, TWO. three"), (12, "")]
    docs = spark.createDataFrame([(d, t, 0.0, 1) for d, t in docs], "doc_id long, text string, score double, item_id int")
    rows = decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == Counter({(d, i): 2 if d == 7 else 1 for d in (None, 7, 8) for i in (1, 2)} | {(11, 4): 1})
    assert all(r.bm25 > 0 and 0.5 <= r.score <= 1 + 1e-6 for r in rows) and {r.passage_start > 50_000 for r in rows if r.doc_id == 8} == {True}


def test_walk_skips_and_scores(spark):
    """Cursors and pivots over many items give the exhaustive scores, with one item in several blocks' reach."""
    import numpy as np
    import pyarrow as pa

    from textloom.llm import _words

    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefghijklmn") + rng.choice("opqr") for _ in range(n))
    items = [text(rng.randint(4, 25)) for _ in range(90)]
    index = decontamination.ItemIndex(list(range(90)), items)
    buf, at = _words.utf8(pa.array([f"{text(30)} {items[i]} {text(30)}" for i in range(0, 90, 7)]))
    w = _words.split(buf, at)
    words = decontamination._core(w)
    got = {(int(d), int(i), s): v for d, i, s, v in index.search(words, w.at, 0.7)}
    want = {}
    for d in range(len(at) - 1):
        x = words[w.at[d] : w.at[d + 1]]
        for s in range(0, max(1, len(x)), index.stride):
            span = np.isin(index.terms, x[s : s + 2 * index.stride])
            score = np.zeros(90)
            for t in np.flatnonzero(span):
                a, b = index.post[t], index.post[t + 1]
                score[index.item[a:b]] += index.weight[a:b]
            want |= {(d, int(i), s): score[i] for i in np.flatnonzero(score >= 0.7 - 1e-6)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in got) and len(got) >= 13
