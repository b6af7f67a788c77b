"""Anagrams, key-value rows, sources, sinks, upsert and streaming."""

from pyspark.sql import functions as F

from textloom.operators import anagram, index, kv
from textloom.sources import readers, segments, writers
from textloom.streaming import incremental

WORDS = ["act", "Act", "012 0", "cat", "fact", "First Act", "2001", "2010", "kame", "The Legend of 1900", "make", "meak"]


def test_anagrams(spark, tmp_path):
    (tmp_path / "words").write_text("\n".join(WORDS) + "\n")
    (tmp_path / "asked").write_text("tac\ntAc\nCat\nc at\nAFci rstt\neamk")
    found = anagram.anagram_index(readers.read_lines(spark, str(tmp_path / "words")))
    lines = [r.line for r in writers.anagram_lines(found).collect()]
    assert lines[:4] == ["   0019LTdeeefghno|The Legend of 1900", " 0012|012 0", " AFcirstt|First Act", "0012|2001"] and lines == sorted(lines)
    asked = readers.read_queries(spark, str(tmp_path / "asked"))
    got = {r.query: r.matches for r in anagram.anagram_lookup(asked, found).collect()}
    assert got == {"tac": ["act", "cat"], "tAc": ["Act"], "Cat": [], "c at": [], "AFci rstt": ["First Act"], "eamk": ["kame", "make", "meak"]}
    writers.write_lines(writers.anagram_lines(found), str(tmp_path / "out"))
    assert readers.read_pairs(spark, str(tmp_path / "out")).count() == 12


def test_key_values(spark):
    store = spark.createDataFrame([(1, "a"), (5, "b")], "key long, payload string")
    new = spark.createDataFrame([("x",), ("y",)], "payload string")
    rows = {r.key: r.payload for r in kv.insert(store, new).collect()}
    assert rows == {1: "a", 5: "b", 6: "x", 7: "y"}
    assert kv.search(store, 5).first().payload == "b" and kv.search(store, 9).count() == 0
    assert kv.search_value(store, "a").first().key == 1
    assert [r.payload for r in kv.ordered(kv.update(store, 1, "z")).collect()] == ["z", "b"]


def test_pages_from_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<collection><page><id>7</id><title>T x</title><text>one {{two}} three</text></page><page><title>no id</title><text>t</text></page><page><id>8</id><text>four</text><revision><id>99</id></revision></page></collection>')
    rows = {r.id: (r.title, r.text) for r in readers.read_pages(spark, str(tmp_path / "p.xml")).collect()}
    assert rows == {7: ("T x", "one {{two}} three"), 8: (None, "four")}
    pages = readers.read_pages(spark, str(tmp_path / "p.xml"))
    assert {r.line for r in writers.title_lines(pages).collect()} == {"7|T x"}
    assert "<title>T x</title>" in {r.id: r.line for r in writers.xml_lines(pages).collect()}[7]


def test_pages_with_attributes(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<mediawiki><page><id>7</id><title>T</title><revision><id>9</id><text bytes="3">one</text></revision></page></mediawiki>')
    assert readers.read_pages(spark, str(tmp_path / "p.xml")).first().text == "one"


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, [3, 9]), ("b", 1, [5])], "term string, doc_id long, positions array<int>")
    new = spark.createDataFrame([("a", 1, [6, 9]), ("a", 2, [1])], "term string, doc_id long, positions array<int>")
    rows = {(r.term, r.doc_id): (r.positions, r.tf) for r in index.upsert(old, new).collect()}
    assert rows == {("a", 1): ([3, 6, 9], 3), ("b", 1): ([5], 1), ("a", 2): ([1], 1)}


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "index")
    for k in range(2):
        spark.createDataFrame([(2 * k, "a b a"), (2 * k + 1, "c")], "doc_id long, text string").coalesce(1).write.parquet(str(src / f"part{k}"))
        incremental.index_stream(spark.readStream.schema("doc_id long, text string").parquet(str(src / "*")), out, str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r.term, r.doc_id): r.positions for r in segments.read(spark, out).collect()}
    assert got == {("a", 0): [1, 5], ("b", 0): [3], ("c", 1): [1], ("a", 2): [1, 5], ("b", 2): [3], ("c", 3): [1]}


def test_streaming_postings(spark, tmp_path):
    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    rows = incremental.streaming_postings(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")))
    q = rows.writeStream.format("memory").queryName("tf").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.term, r.tf) for r in spark.table("tf").collect()} == {("a", 2), ("b", 1)}


def test_queries_match_sql(spark):
    """Every query with SQL gives the same rows on the smallest tables."""
    import duckdb

    from textloom import queries as q

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "part", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("anagram_order", "stopword_filter", "index_lines", "ranked_batch", "stemmed_postings", "kv_insert", "query_files", "xml_pages", "xml_cleaner", "xml_valid_pages", "xml_sink", "tag_bodies", "index_rewrite", "incremental_index", "index_merge_join", "xml_quarantine", "index_lines_roundtrip", "page_lines", "normalize_page"):
        found = con.execute(q.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        got = q.queries()[name](spark, d)
        assert set(got.columns) == set(columns)
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, found.fetchall())), name


def same_as_sql(spark, name, tables=("documents", "pages")):
    """Rows of the query and of its SQL, the same ones, on the smallest tables."""
    import duckdb

    from textloom import queries as q

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    found = con.execute(q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    rows = q.queries()[name](spark, d).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, found.fetchall()))
    return rows


def test_xml_keeps_cleaned_texts(spark):
    pages = spark.createDataFrame([(1, "T", "one {{gone}} two a&b x|y " + "z" * 20), (2, None, None)], "id long, title string, text string")
    lines = {r.id: r.line for r in writers.xml_lines(writers.clean_pages(pages)).collect()}
    assert "<text>one two a x y</text>" in lines[1] and "<text></text>" in lines[2]
    assert all("<text></text>" not in r.line for r in same_as_sql(spark, "xml_clean_sink"))


def test_stemmed_pages(spark):
    from textloom.functions import text as T

    pages = spark.createDataFrame([(1, "T ", "Running, the ponies"), (2, None, "the"), (3, None, None), (4, None, "cats"), (4, None, "dogs")], "id long, title string, text string")
    rows = sorted((r.id, r.text) for r in T.normalise_pages(pages, ["the"], T.porter_stems(T.page_words(pages))).collect())
    assert rows == [(1, "t run poni"), (2, ""), (3, ""), (4, "cat"), (4, "dog")]
    assert same_as_sql(spark, "normalize_page_stemmed")


def test_anagrams_of_every_word(spark):
    assert len({len(r.query) for r in same_as_sql(spark, "anagram_lookup")}) > 10


def test_many_inserted_keys(spark):
    """Keys are gapless and in order of the payload, whatever the partitions, with one payload in a third of the rows."""
    from pyspark.sql import functions as F

    payload = F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.md5(F.col("id").cast("string")))
    new = spark.range(0, 120_000, 1, 13).select(payload.alias("payload"), F.when(F.col("id") == 5, F.lit(900_000)).cast("long").alias("key"))
    store = spark.createDataFrame([(7, "old")], "key long, payload string")
    rows = sorted((r.key, r.payload) for r in kv.insert(store, new).collect())
    assert [k for k, _ in rows] == [7, 900_000, *range(900_001, 900_001 + 119_999)]
    assert [p for _, p in rows[2:]] == sorted(p for _, p in rows[2:])
    none = spark.createDataFrame([], "payload string")
    assert kv.insert(none.withColumn("key", F.lit(None).cast("long")), none).count() == 0


def test_valid_pages(spark):
    pages = spark.createDataFrame([(1, "t", "x"), (2, None, "x"), (None, "t", "x"), (4, "t", None), (5, "", "")], "id long, title string, text string")
    assert {r.id for r in readers.valid_pages(pages).collect()} == {1, 5}


def test_index_lines_are_whole(spark):
    """A term has one line, in the order of documents, whatever parts it was made of (F7)."""
    from textloom.operators import index
    from textloom.sources import writers

    docs = spark.createDataFrame([(d, "alpha beta") for d in (700, 5, -3, 301)], "doc_id long, text string")
    lines = {r.term: r.line for r in writers.whole_lines(index.build(docs).weights(), docs=100).collect()}
    assert lines == {"alpha": "alpha|-3:1/2/4:5;5:1/2/4:5;301:1/2/4:5;700:1/2/4:5;", "beta": "beta|-3:1/2/4:10;5:1/2/4:10;301:1/2/4:10;700:1/2/4:10;"}


def test_whole_lines_and_cleaned_pages_match_sql(spark):
    for name in ("index_lines", "xml_pages"):
        same_as_sql(spark, name)
    from textloom import queries as q

    assert "part" not in q.queries()["index_lines"](spark, "/root/testdata/sf0.001").columns
    assert q.queries()["xml_pages"](spark, "/root/testdata/sf0.001").where("text = '' or text rlike '[{}&<>]'").count() == 0


def test_terms_leave_their_task_as_postings(spark):
    """Texts move once and nothing is sorted; rows of one doc_id are taken together, as tokens are (F8)."""
    from textloom.functions import text as T
    from textloom.operators import index

    rows = [(1, "The that, THAT\tx<y  end"), (2, None), (3, ""), (4, "a" * 30 + " b"), (None, "n\nn"), (5, "Kelvin İx café \U0001f600 z")]
    for some in (rows, [*rows, (1, "that is longer than the first row of it"), (None, "m")]):
        docs = spark.createDataFrame(some, "doc_id long, text string")
        for stop in (None, ["that", "x"]):
            old = T.tokens(docs, stop).groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
            new = index.sized_terms(docs, stop).select("doc_id", "term", "positions").collect()
            assert sorted(map(repr, map(tuple, old))) == sorted(map(repr, map(tuple, new)))
    plan = index.sized_terms(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1
