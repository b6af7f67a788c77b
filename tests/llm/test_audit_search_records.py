"""Source audit, ranked search and token records against plain versions and the tokenizers library."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import ranked_search, source_audit, token_records

SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, item int, file string, _row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "f", "r") for r in rows], SCHEMA)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["", "é", "Z", "7", "ß"]) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "_x", "-ÀB", "\0q"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for i in range(n)]
    rows += [(1000, None, "en", "s1"), (1001, "", "xx", "s9"), (1002, " !! ", "xx", "s8"), (None, "aé aé", "en", "s1"), (None, None, None, None), (1003, "a " * 20_000, "de", "s2"), *[(2000, "aa bb cc", "de", "s3")] * 4]
    return rows


# ---- source audit
def plain_audit(rows, ranks=200):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall((text or "").translate(LOWER))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= 3]
        own = sorted(s for x, s in groups if x == lang)

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        ps = {s: p(count[lang, s]) for s in own}
        whole = p(sum((count[lang, s] for s in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            for part, found in (("pair", [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in own if o != s]), ("term", [(f(ps[s][t], whole[t]), t) for t in kept if count[lang, s][t] and ps[s][t] > whole[t]])):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= ranks]
    return sorted(out)


def test_source_audit(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = source_audit.audit(frame(spark, rows), ranks=5)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, 5)


def test_source_audit_edges(spark):
    assert source_audit.audit(frame(spark, [])).count() == 0
    # a language that keeps no term still has its pairs
    rows = [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "", None, None)]
    assert sorted(map(tuple, source_audit.audit(frame(spark, rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_beyond_a_long(spark):
    from pyspark.sql import functions as F

    n = 10**13  # 10**9 times this is no long
    df = spark.range(1).select(source_audit.share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p"))
    assert df.first()[0] == 1 + 10**9 * (n + 1) // (3 * n + 7)


# ---- ranked search
def plain_search(rows, items, k=50):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    tfs = [(d, Counter(term.findall((t or "").translate(LOWER)))) for d, t, *_ in rows]
    tfs = [(d, c, sum(c.values())) for d, c in tfs if c]
    n, total, df = len(tfs), sum(x[2] for x in tfs), Counter()
    for _, c, _ in tfs:
        df.update(c.keys())
    out = []
    for item, text in items:
        asked = {t for t in term.findall((text or "").translate(LOWER)) if df[t]}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked}
        found = []
        for d, c, size in tfs:
            m = 50 + 50 * size * n // total
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


ITEMS = [(1, "aé bb Cc cc"), (2, None), (3, "nothing-here zzzz"), (4, "a"), (4, "a"), (None, "aa bb cc hhhß x"), (7, "A7 a7"), (8, " ".join(a * n + s for a in "abcdefgh" for n in (1, 2, 3) for s in ("", "é", "7")))]


@pytest.mark.parametrize(("k", "entries", "items"), [(50, 10**6, 20_000), (3, 10**6, 20_000), (3, 20, 2)])
def test_ranked_search(spark, monkeypatch, k, entries, items):
    monkeypatch.setattr(ranked_search, "CELLS", 20)
    rows = corpus(3, 400)
    asked = spark.createDataFrame([(i, t, "q", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, score int")
    got = ranked_search.search(frame(spark, rows).repartition(3), asked, k, entries, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert _sorted(got.collect()) == _sorted(plain_search(rows, ITEMS, k))


def test_ranked_search_edges(spark):
    asked = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(frame(spark, []), asked).count() == 0
    assert ranked_search.search(frame(spark, corpus(1)), asked.limit(0)).count() == 0
    assert ranked_search.search(frame(spark, [(1, None, None, None), (2, "", "", "")]), asked).count() == 0
    # a term in every document weighs nothing, so no document has a score above 0
    assert ranked_search.search(frame(spark, [(i, "a", "", "") for i in range(700)]), asked).count() == 0


def test_pruned_terms(spark):
    """Terms whose parts stay below the threshold generate no candidates: without rare matches a task returns nothing."""
    lines = np.array([(0, 0, 100, 9000, 30_000), (0, 1, 1, 9000, 500)], np.int64).T
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array([100, 100]), pa.array([[1], [0, 1]], pa.list_(pa.int32())), pa.array([[3], [1, 1]], pa.list_(pa.int32()))], names=["doc_id", "m", "terms", "tf"])
    run = ranked_search.candidates(lines, 1, 2, 1)
    assert [r["doc_id"] for b in run(iter([batch])) for r in b.to_pylist()] == [6]


def test_terms_are_compared_byte_by_byte(monkeypatch):
    from textloom.llm import _words

    monkeypatch.setattr(_words.Words, "hashes", lambda self, seed=0: np.arange(len(self.start)).astype(np.uint64) % np.uint64(2))
    buf = np.frombuffer(b"ab xy ac", np.uint8)
    words = _words.split(buf, np.array([0, 8]))
    which, number = ranked_search.Vocabulary(["ab", "cd"]).find(words)
    assert (which.tolist(), number.tolist()) == ([0], [0])


# ---- token records
def test_checksums():
    mask = lambda c: ((c >> 15 | c << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF

    def plain(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return mask(c ^ 0xFFFFFFFF)

    assert plain(b"123456789") == mask(0xE3069283)  # the published check value
    parts = [random.Random(n).randbytes(n) for n in (4, 8, 17, 511, 512, 513, 1024, 5000)]
    assert token_records.masked_crc32c(parts).tolist() == [plain(p) for p in parts]
    assert token_records.masked_crc32c([]).tolist() == []


ODD = ["İ, x's don't. 's", "naïve, é क़, ẞ! K. <|endoftext|> <|ENDOFTEXT|>", "a\0b\nc\td\xa0e,\n\nF.", "H̱, ẖ.", "x" * 5000, "word, " * 4000, "1234 5.6 ,;. ..", " line"]


def expected(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(token_records.tokenizer_path()), 0, []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digest(rows):
    return [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows]


def test_token_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_records, "SEGMENT", 2000)
    monkeypatch.setattr(token_records, "READ_BYTES", 100)
    rows = [(i * 3, t) for i, t in enumerate([*ODD, None, "", *(r[1] for r in corpus(4))])] + [(-5, "minus"), (None, "no id")]
    docs = frame(spark, [(d, t, None, None) for d, t in rows]).repartition(5)
    token_records.write(docs, f"file://{tmp_path}/a", token_records.tokenizer_path(), file_bytes=700)
    want = expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    got = token_records.read(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert digest(got) == want
    files = spark.read.parquet(f"{tmp_path}/a/files").orderBy("place").collect()
    assert len(files) > 3 and sum(f.ids for f in files) == sum(x[2] for x in want)
    assert {f.file for f in files} == {p.name for p in (tmp_path / "a/records").iterdir()}
    # the same records at their offsets, in a drawn order
    drawn = token_records.shuffled(spark, f"file://{tmp_path}/a", 7)
    some = token_records.read_some(spark, f"file://{tmp_path}/a", drawn)
    assert sorted(digest(some.collect()), key=lambda r: r[1]) == want
    assert [r.row for r in drawn.collect()] != [r.row for r in token_records.shuffled(spark, f"file://{tmp_path}/a", 8).collect()]


def test_token_records_ties_and_whole_texts(spark, tmp_path):
    """Rows of one doc_id stand side by side; a tokenizer that merges across spaces gets whole texts."""
    docs = frame(spark, [(1, t, None, None) for t in ("b c", "a", "a", None)] + [(0, "z", None, None)])
    token_records.write(docs, str(tmp_path / "x"), token_records.tokenizer_path(), apart=False)
    got = token_records.read(spark, str(tmp_path / "x")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 1, 1, 1, 1]
    assert sorted(x[2:] for x in digest(got)) == sorted(x[2:] for x in expected([(0, "z"), (1, "b c"), (1, "a"), (1, "a"), (1, None)]))


def test_token_records_damage(spark, tmp_path):
    token_records.write(frame(spark, [(1, "some words here", None, None)]), str(tmp_path / "x"), token_records.tokenizer_path())
    (file,) = (tmp_path / "x/records").iterdir()
    raw = file.read_bytes()
    for place in (1, 9, 30, len(raw) - 1):
        file.write_bytes(raw[:place] + bytes([raw[place] ^ 1]) + raw[place + 1 :])
        with pytest.raises(Exception, match="record"):
            token_records.read(spark, str(tmp_path / "x")).collect()
    file.write_bytes(raw[:-3])
    with pytest.raises(Exception, match="ends within a record"):
        token_records.read(spark, str(tmp_path / "x")).collect()


def test_token_records_empty(spark, tmp_path):
    token_records.write(frame(spark, []), str(tmp_path / "x"), token_records.tokenizer_path())
    assert token_records.read(spark, str(tmp_path / "x")).count() == 0


def test_leftover_files_go(spark, tmp_path):
    path = str(tmp_path / "x")
    token_records.write(frame(spark, [(1, "a", None, None)]), path, token_records.tokenizer_path())
    (tmp_path / "x/records/000000-0000-dead.rec").write_bytes(b"half a reco")
    token_records._tidy(spark, path)
    assert len(list((tmp_path / "x/records").iterdir())) == 1
    assert token_records.read(spark, path).count() == 1
