"""Indexes in segments: batches, streams, replays, replaced and deleted pages, merges, and writers that end early or meet."""

import random
import re
from collections import Counter, defaultdict

import pytest

from textloom.operators import index
from textloom.plans import search
from textloom.sources import readers, segments
from textloom.streaming import incremental

PAGE = "doc_id long, text string"


def batch(spark, *rows, schema=PAGE):
    return spark.createDataFrame(list(rows), schema)


def words(spark, path):
    out = defaultdict(Counter)
    for r in segments.read(spark, path).collect():
        out[r.doc_id][r.term] = r.tf
    return {d: dict(c) for d, c in out.items()}


def facts(i):
    """What a ranked search needs: N, sizes, df."""
    df = {r.term: r.df for r in (index.document_frequency(i.postings) if i.terms is None else i.terms).collect()}
    return i.n_docs, {r.doc_id: (r.n_tokens, r.n_terms) for r in i.sizes.collect()}, df


def plain_facts(pages):
    tokens = {d: [w for w in re.sub("[^a-z0-9 ]", "", (t or "").lower()).split(" ") if w] for d, t in pages.items()}
    df = Counter(w for ws in tokens.values() for w in {w for w in ws if len(w) < 25})
    return len(pages), {d: (len(ws), len({w for w in ws if len(w) < 25})) for d, ws in tokens.items()}, dict(df)


def test_batches_replays_and_merges(spark, tmp_path):
    path = str(tmp_path / "i")
    for k in range(6):
        incremental.merge_batch(spark, batch(spark, (k, f"w{k} all")), path, epoch=k, limit=3)
    assert len(segments.live(spark, path)) <= 3
    before = segments.live(spark, path)
    for k in (5, 0):  # also an epoch whose segment has long been merged
        incremental.merge_batch(spark, batch(spark, (k, "other")), path, epoch=k)
    assert segments.live(spark, path) == before
    incremental.merge_batch(spark, batch(spark, (3, "w3 all")), path, limit=3)  # pages that come again, without an epoch
    assert words(spark, path) == {k: {f"w{k}": 1, "all": 1} for k in range(6)}
    assert facts(segments.open_index(spark, path)) == plain_facts({k: f"w{k} all" for k in range(6)})


def test_two_streams_into_one_index(spark, tmp_path):
    """Both begin with epoch 0; neither loses a page, and a stream that is run again over its checkpoint adds nothing."""
    path = str(tmp_path / "i")
    for name in ("a", "b"):
        batch(spark, (ord(name), f"page {name}")).coalesce(1).write.parquet(str(tmp_path / name / "x"))
        for _ in range(2):
            pages = spark.readStream.schema(PAGE).parquet(str(tmp_path / name / "*"))
            incremental.index_stream(pages, path, str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    assert words(spark, path) == {97: {"page": 1, "a": 1}, 98: {"page": 1, "b": 1}}
    _, now = segments.state(spark, path)
    assert sorted(now["done"].values()) == [0, 0] and len(now["segments"]) == 2
    # a batch whose manifest was written before the stream could say so comes again
    (stream, _), *_ = now["done"].items()
    incremental.merge_batch(spark, batch(spark, (1, "again")), path, epoch=0, stream=stream)
    assert 1 not in words(spark, path)


def test_replaced_and_deleted_pages(spark, tmp_path):
    """Random batches against a dictionary, with merges at every place."""
    path, rng, model = str(tmp_path / "i"), random.Random(3), {}
    for step in range(7):
        new = {d: " ".join(rng.choices(["red", "green", "blue", "x" * 30, "-"], k=rng.randint(0, 5))) for d in rng.sample(range(12), 5)}
        gone = [d for d in rng.sample(range(12), 3) if d not in new]
        rows = [(d, t if t or rng.random() < 0.5 else None) for d, t in new.items()]
        incremental.merge_batch(spark, batch(spark, *rows), path, deletes=batch(spark, *[(d, None) for d in gone]), limit=2 + step % 2)
        model = {d: t for d, t in {**model, **new}.items() if d not in gone}
        i = segments.open_index(spark, path)
        assert facts(i) == plain_facts(model), step
    asked = [(1, "red blue"), (2, "red AND green"), (3, "bl*")]
    want = search.search(index.build(batch(spark, *model.items())), asked).collect()
    assert sorted(map(repr, search.search(i, asked).collect())) == sorted(map(repr, want)) and want


def test_one_page_twice_in_a_batch(spark, tmp_path):
    path = str(tmp_path / "i")
    incremental.merge_batch(spark, batch(spark, (1, "old", 1), (1, "new", 2), (2, "b", 1), (2, "c", 1), (None, "none", 1), schema=PAGE + ", version long"), path)
    assert words(spark, path) == {1: {"new": 1}, 2: {"c": 1}}
    assert segments.open_index(spark, path).n_docs == 2


def test_pages_of_long_words_only(spark, tmp_path):
    """They have a size and count as pages, in segments and in written indexes."""
    rows = [(1, "x" * 30), (2, "a b"), (3, ""), (4, None)]
    incremental.merge_batch(spark, batch(spark, *rows), str(tmp_path / "i"))
    i = segments.open_index(spark, str(tmp_path / "i"))
    assert i.n_docs == 4 and {r.doc_id: r.n_tokens for r in i.sizes.collect()} == {1: 1, 2: 2, 3: 0, 4: 0}
    index.build(batch(spark, *rows)).write(str(tmp_path / "w"))
    back = index.Index.read(spark, str(tmp_path / "w"))
    assert back.n_docs == 4 and {(r.doc_id, r.n_tokens, r.n_terms) for r in back.sizes.collect()} == {(1, 1, 0), (2, 2, 2)}


def test_writers_that_end_early_or_meet(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    incremental.merge_batch(spark, batch(spark, (1, "a")), path)
    publish = segments.publish

    def dies(*_):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(segments, "publish", dies)
    with pytest.raises(RuntimeError):
        incremental.merge_batch(spark, batch(spark, (2, "b")), path, epoch=0)
    assert words(spark, path) == {1: {"a": 1}}

    met = []

    def second(spark, where, seen, new):
        if not met:  # another writer is faster, and replaces the page that this one brings
            met.append(1)
            monkeypatch.setattr(segments, "publish", publish)
            incremental.merge_batch(spark, batch(spark, (2, "theirs"), (3, "c")), path)
            monkeypatch.setattr(segments, "publish", second)
        publish(spark, where, seen, new)

    monkeypatch.setattr(segments, "publish", second)
    incremental.merge_batch(spark, batch(spark, (2, "ours")), path, epoch=0)
    assert words(spark, path) == {1: {"a": 1}, 2: {"ours": 1}, 3: {"c": 1}}
    assert segments.open_index(spark, path).n_docs == 3
    seen, now = segments.state(spark, path)
    with pytest.raises(segments.Conflict):
        publish(spark, path, seen - 1, now)


def test_old_segments_stay_for_readers(spark, tmp_path):
    path = str(tmp_path / "i")
    for k in range(3):
        incremental.merge_batch(spark, batch(spark, (k, "a")), path, limit=1)
    old = segments.read(spark, path)  # not computed yet
    incremental.merge_batch(spark, batch(spark, (9, "a")), path, limit=1)
    assert old.count() == 3
    segments.clean(spark, path, keep=0)
    assert len(segments.versions(spark, path)) == 1 and segments.read(spark, path).count() == 4
    named = set(segments.live(spark, path))
    assert {p.name for p in (tmp_path / "i").iterdir() if p.name.startswith("segment-")} == named


def test_rewrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "i")
    assert segments.read(spark, path).count() == 0 and segments.open_index(spark, path).n_docs == 0
    incremental.merge_batch(spark, batch(spark, (1, "a b"), (2, "b")), path)
    segments.rewrite(segments.read(spark, path).where("doc_id = 1"), path)
    assert words(spark, path) == {1: {"a": 1, "b": 1}} and segments.open_index(spark, path).n_docs == 1
    incremental.merge_batch(spark, batch(spark).limit(0), path)
    assert words(spark, path) == {1: {"a": 1, "b": 1}}


# ---- pages and lines from files
BROKEN = """<collection>
<page><id>1</id><title>good &amp; first</title><text>a &lt;b&gt; c</text></page>
<page><id>2</id><title>stray</title><text xml:space="preserve">two </ref> x</text></page>
<page><id>3</id><text>br <br> x</text></page><page><id>4</id><text>a & b &lt;</text></page>
<page><id>x5</id><text>five</text></page><page><title>none</title><text>no id</text></page>
<page><id>7</id></page><page><id>8</id><text>no end of the page</text>
<page><id>9</id><title/><text/></page><page><id>10</id><revision><id>1</id><text bytes="1">in revision</text></revision></page>
<page><id>11</id><text><![CDATA[ raw <i> & ]]></text></page>
</page><page><id>12</id><text>after a stray page end</text></page>
<page><id>13</id><text>never ends
"""


def test_broken_pages(spark, tmp_path):
    (tmp_path / "a.xml").write_text(BROKEN)
    (tmp_path / "b.xml").write_text("<collection><page><id>20</id><text>last</text></page></collection>")
    rows = {r.id if r.id is not None else r.problem: (r.title, r.text, r.problem) for r in readers.parse_pages(readers.page_chunks(spark, str(tmp_path))).collect()}
    assert rows == {
        1: ("good & first", "a <b> c", None), 2: ("stray", "two </ref> x", "markup"), 3: (None, "br <br> x", "markup"), 4: (None, "a & b <", "markup"),
        "bad id": (None, "five", "bad id"), "no id": ("none", "no id", "no id"), 7: (None, None, "no text"), 8: (None, "no end of the page", "markup"), 9: ("", "", None),
        10: (None, "in revision", None), 11: (None, " raw <i> & ", None), 12: (None, "after a stray page end", None), 13: (None, None, "markup"), 20: (None, "last", None),
    }
    read = lambda **k: {r.id for r in readers.read_pages(spark, str(tmp_path), **k).collect()}
    assert read(recover=False) == {1, 9, 10, 11, 12, 20} and read() == {1, 2, 3, 4, 8, 9, 10, 11, 12, 20}
    broken = readers.broken_pages(spark, str(tmp_path))
    assert {r.problem: r["count"] for r in broken.groupBy("problem").count().collect()} == {"markup": 5, "bad id": 1, "no id": 1, "no text": 1}
    assert all(r.raw.startswith("<page") and r.file.endswith("a.xml") for r in broken.collect())


def test_pages_across_splits(spark, tmp_path):
    """However a file is split, each page is read once."""
    (tmp_path / "a.xml").write_text("<c>" + "".join(f"<page><id>{i}</id><text>{'é' * (i % 50)} {'</x>' if i % 7 == 0 else ''}</text></page>\n" for i in range(300)) + "</c>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        pages = readers.read_pages(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() > 10 and sorted(r.id for r in pages.collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cleaner_keeps_broken_pages_apart(spark, tmp_path):
    from textloom.sources import cleaner

    (tmp_path / "a.xml").write_text(BROKEN)
    cleaner.clean_dump(spark, str(tmp_path / "a.xml"), str(tmp_path / "out"), quarantine=str(tmp_path / "bad"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines.count("<page>") == 9 and "<text>two ref x</text>" in lines
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 8


def test_stream_of_dumps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.xml").write_text(BROKEN)
    run = lambda: incremental.index_stream(readers.stream_pages(spark, str(tmp_path / "in"), files=1), str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    run()
    (tmp_path / "in/2.xml").write_text("<c><page><id>1</id><title>new</title><text>replaced</text></page></c>")
    run()
    i = segments.open_index(spark, str(tmp_path / "i"))
    titles = {r.doc_id: r.title for r in i.sizes.collect()}
    assert titles == {1: "new", 2: "stray", 3: None, 4: None, 8: None, 9: "", 10: None, 11: None, 12: None} and i.n_docs == 9
    assert [r.doc_id for r in search.search(i, [(1, "replaced")]).collect()] == [1] and search.lookup(i, "c").count() == 0


def test_index_lines(spark, tmp_path):
    from textloom.sources import writers

    docs = batch(spark, *[(d, "alpha beta alpha") for d in (-3, 5, 1_500_000)])
    lines = writers.index_lines(index.build(docs).weights(), docs=100)
    assert {(r.term, r.part) for r in lines.collect()} == {(t, p) for t in ("alpha", "beta") for p in (-1, 0, 15_000)}
    writers.write_lines(lines, str(tmp_path / "a"))
    (tmp_path / "a/more.txt").write_text("alpha|5:1/3/3:99;7:oops;9:1/1/3:4;\n|1:1/1/1:1;\nno bar\nempty|\n")
    rows, bad = readers.read_index_lines(spark, str(tmp_path / "a"))
    got = {(r.term, r.doc_id): (r.positions, r.tf, r["size"]) for r in rows.collect()}
    assert got["alpha", 5] == ([5, 16, 99], 3, 3) and got["alpha", 9] == ([4], 1, 1) and got["beta", -3] == ([10], 1, 3) and len(got) == 7
    assert {(r.problem, r.line) for r in bad.collect()} == {("bad posting", "alpha|5:1/3/3:99;7:oops;9:1/1/3:4;"), ("no term", "|1:1/1/1:1;"), ("no term", "no bar"), ("no posting", "empty|")}
    assert search.search(readers.index_of_lines(spark, str(tmp_path / "a"), 4), [(1, "beta")]).count() == 3


def test_queries_of_several_files(spark, tmp_path):
    (tmp_path / "q1").write_text("one\n\nthree words here\r\nfour")
    (tmp_path / "q2").write_text("five\n")
    assert [(r.qid, r.query) for r in readers.read_queries(spark, str(tmp_path / "q*")).orderBy("qid").collect()] == [(1, "one"), (3, "three words here"), (4, "four"), (5, "five")]


def test_open_page_at_the_end_of_a_file(spark, tmp_path):
    page = "<page>\n<title>P</title>\n<id>{0}</id>\n<text>t</text>\n"
    (tmp_path / "open").mkdir()
    for name, end in (("a", "\n"), ("b", ""), ("c", "</page>"), ("d", "</page>\n</collection>\n")):
        at = ord(name) * 10
        (tmp_path / "open" / f"{name}.xml").write_text("<collection>" + page.format(at) + "</page>" + page.format(at + 1) + end)
    bad = readers.broken_pages(spark, str(tmp_path / "open")).collect()
    assert sorted((r.id, r.title, r.text, r.problem) for r in bad) == [(971, "P", "t", "markup"), (981, "P", "t", "markup")]
    assert readers.read_pages(spark, str(tmp_path / "open")).count() == 8
    assert readers.read_pages(spark, str(tmp_path / "open"), recover=False).count() == 6
