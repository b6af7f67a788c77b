"""How a stored index is written: texts are split once, what moves is bounded by what is stored, and files, blocks and grams say the same as the postings."""

import re

from pyspark.sql import functions as F

from textloom.functions import wildcard
from textloom.operators import index
from textloom.plans import blocks, search
from textloom.sources import readers, segments
from textloom.streaming import incremental

PAGE = "doc_id long, text string"


def texts(spark, n=300):
    words = [f"w{i}" for i in range(40)]
    return spark.createDataFrame([(i * 3 - 50, " ".join(["all", *[words[(i * k) % 40] for k in range(1, 6)], f"x{i}"])) for i in range(n)] + [(None, "all none"), (5000, "a" * 30), (5003, None)], PAGE)


def test_texts_are_split_once(spark, tmp_path, monkeypatch):
    """Postings and sizes come from one pass over all texts; before, the texts were split three times (F11, F13, F17 to F21)."""
    calls = []
    mapped = index._mapped
    monkeypatch.setattr(index, "_mapped", lambda docs, *a, **k: calls.append(k) or mapped(docs, *a, **k))
    i = index.build(texts(spark))
    rows, layout = i.source()
    assert [k.get("layout") for k in calls if k.get("layout")] == [layout]
    plan = rows.repartitionById(layout.files, F.col("file"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # whose bounds would be sampled from texts that are split for that


def test_stored_rows_are_those_of_the_texts(spark, tmp_path):
    i = index.build(texts(spark))
    i.write(str(tmp_path))
    stored = index.Index.read(spark, str(tmp_path))
    same = lambda a, b, *c: sorted(map(repr, a.select(*c).collect())) == sorted(map(repr, b.select(*c).collect()))
    assert same(i.postings, stored.postings, "term", "doc_id", "positions", "tf", "n_tokens", "n_terms")
    assert same(i.sizes, stored.sizes, "doc_id", "n_tokens", "n_terms")
    assert stored.sizes.where("doc_id = 5000").count() == 1 and stored.n_docs == 303
    assert {r.term: r.df for r in stored.terms.collect()} == {r.term: r.df for r in index.document_frequency(i.postings).collect()}


def test_hot_terms_take_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FILE_ROWS", 100)
    monkeypatch.setattr(index, "SAMPLED", 50)
    i = index.build(texts(spark))
    i.write(str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/postings").select("term", "doc_id", F.col("_metadata.file_name").alias("file"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"), F.collect_list(F.struct("term", "doc_id")).alias("rows")).collect()
    assert sum(any(r.term == "all" for r in f.rows) for f in files) > 1 and max(f.n for f in files if f.rows[0].term is not None) < 600
    for f in files:
        keys = [(r.term or "", -(1 << 60) if r.doc_id is None else r.doc_id) for r in f.rows]
        assert keys == sorted(keys)
    stored = index.Index.read(spark, str(tmp_path))
    assert stored.of(["all"]).count() == i.of(["all"]).count() == 301


def test_blocks_without_an_exchange(spark, tmp_path):
    """Blocks are made of the sorted files as they stand; a block that a batch ends in has several rows, which count together."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    i = index.build(texts(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        i.write(str(tmp_path))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    stored = index.Index.read(spark, str(tmp_path))
    words = {"all", "w1", "x7"}
    assert stored.blocks.where("term = 'all'").count() > stored.blocks.where("term = 'all'").select("block").distinct().count()
    want = {w: {} for w in words}
    for r in stored.postings.where(F.col("term").isin(*words) & F.col("doc_id").isNotNull()).collect():
        b = (r.doc_id + 50) // 64
        n, a, z, best = want[r.term].get(b, (0, r.doc_id, r.doc_id, 0.0))
        want[r.term][b] = (n + 1, min(a, r.doc_id), max(z, r.doc_id), max(best, r.tf / r.n_tokens))
    assert blocks.block_rows(stored, words) == want


def test_stored_grams_answer_every_pattern(spark, tmp_path):
    """A third of the grams is stored, and still each pattern finds its terms."""
    words = "at cat cap atter cip catter ape aper a t that thing throwing".split()
    frame = spark.createDataFrame([(w,) for w in words], "term string")
    assert wildcard.starts(frame).count() < wildcard.gram_table(frame).count() / 2
    assert set(map(tuple, wildcard.begun(wildcard.starts(frame)).where("gram not in ('^', '$')").collect())) == set(map(tuple, wildcard.gram_table(frame).collect()))
    index.build(spark.createDataFrame([(1, " ".join(words))], PAGE)).write(str(tmp_path))
    i = index.Index.read(spark, str(tmp_path))
    for pattern in ("*", "*t", "c*p", "a*", "*t*", "*a*e", "ca*t*r", "a", "**", "*tte*", "c*tt*r", "th*in*g", "*ing"):
        assert {r.term for r in search.expansions(i, pattern).collect()} == {w for w in words if re.search(wildcard.to_regex(pattern), w)}, pattern


def test_batches_exchange_no_texts_unless_a_page_comes_twice(spark, tmp_path):
    """(F12, F23, F24, F25)"""
    one = incremental.newest(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], PAGE))
    assert sorted((r.doc_id, r.text) for r in one.collect()) == [(1, "a"), (2, "b")]
    two = incremental.newest(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None)], PAGE + ", version int"))
    assert [(r.doc_id, r.text) for r in two.collect()] == [(1, "b")]
    path = str(tmp_path / "i")
    incremental.merge_batch(spark, spark.createDataFrame([(1, "a b"), (2, "a" * 30), (3, None)], PAGE), path)
    i = segments.open_index(spark, path)
    assert {(r.doc_id, r.n_tokens, r.n_terms) for r in i.sizes.collect()} == {(1, 2, 2), (2, 1, 0), (3, 0, 0)}


def test_rewritten_index_is_exchanged_once(spark, tmp_path, monkeypatch):
    """An index and the pages it lacks: rows are packed for one exchange and written once, nothing is staged or grouped; pages of long words only stay (F9)."""
    kept = segments.staged
    monkeypatch.setattr(segments, "staged", lambda df, name: kept(df, name) if name == "both" else 1 / 0)
    path, docs = str(tmp_path), texts(spark).where("doc_id is not null")
    rows, layout = index.laid_out(docs.where("doc_id % 2 = 0"))
    assert rows.columns == ["file", "rows"] and layout.files > 2
    segments.rewrite(rows, path, layout)
    old = segments.rows(spark, path)
    new = segments.lacking(docs, old.where("term is null"))
    assert {r.doc_id for r in new.collect()} == {r.doc_id for r in docs.where("doc_id % 2 <> 0 or text is null").collect()}
    rows, layout = index.laid_out(new, old=old)
    segments.rewrite(rows, path, layout)
    got, want = segments.open_index(spark, path), index.build(docs)
    for a, b in ((got.postings, want.postings), (got.sizes.drop("title"), want.sizes)):
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    assert got.sizes.where("doc_id = 5000").count() == 1 and len(segments.live(spark, path)) == 1
    assert {r.term: r.df for r in got.terms.collect()} == {r.term: r.df for r in index.document_frequency(want.postings).collect()}


def test_batches_that_stand_in_files_are_not_written(spark, tmp_path, monkeypatch):
    """(F12, F23, F25)"""
    monkeypatch.setattr(incremental, "staged", lambda *_: 1 / 0)
    path = str(tmp_path)
    incremental.merge_batch(spark, spark.createDataFrame([(1, "a b"), (2, "a")], PAGE), path, write=False)
    incremental.merge_batch(spark, spark.createDataFrame([(2, "c c")], PAGE), path, limit=1, write=False)
    assert sorted((r.term, r.doc_id, r.tf) for r in segments.read(spark, path).collect()) == [("a", 1, 1), ("b", 1, 1), ("c", 2, 2)]


def test_postings_meet_their_df_without_an_exchange(spark, monkeypatch):
    """Only those of seldom terms are exchanged (F12)."""
    monkeypatch.setattr(index, "BROADCAST_ROWS", 2)
    rows = spark.createDataFrame([(t, d) for t, n in (("a", 9), ("b", 8), ("c", 3), ("d", 1)) for d in range(n)], "term string, doc_id long")
    df = index.document_frequency(rows)
    got = index._often_and_seldom(rows, df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(df, "term").collect())) and "LeftAnti" in got._jdf.queryExecution().toString()
    monkeypatch.setattr(index, "BROADCAST_ROWS", 4)
    assert "SortMergeJoin" not in index._often_and_seldom(rows, df)._jdf.queryExecution().executedPlan().toString()


def test_lines_are_exchanged_not_postings(spark, tmp_path):
    """(F15)"""
    (tmp_path / "a.txt").write_text("x|1:1/2/1:3;2:1/2/1:4;\n")
    rows, _ = readers.read_index_lines(spark, str(tmp_path))
    plan = rows.groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the plan stands upside down


def test_dump_is_written_once(spark, tmp_path):
    """(F24)"""
    from textloom import queries

    spark.createDataFrame([(i, f"text {i}") for i in range(6)], PAGE).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    dump = queries._dump(spark, str(tmp_path), files=3)
    assert len(spark.read.text(dump).inputFiles()) == 3 and readers.read_pages(spark, dump).count() == 6
