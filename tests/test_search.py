"""Golden answers on a collection of 14 short pages, and properties of the search operators."""

import pytest

from textloom.functions.text import porter_stem, porter_stems
from textloom.functions.wildcard import to_regex
from textloom.operators import index
from textloom.plans import qlang, search

# The pages and queries of a small known collection, as data to search; the scores are computed here.
PAGES = """2001 2001 space odyssei
armstrong first man moon
yuri gagarin first man orbit space
kubrik movi includ full metal jacket 2001 space odyssei
danger killer kiss
killer murder woman kiss
1984 orwel masterpiec
full metal jacket bullet hunt
recent nasa program space explor
clockwork orange
orange swiss clockwork
fear destruct glori pride
homer odyssei and space odyssey
test test after 12""".split("\n")
STOP = ["first", "man", "full", "and", "after", "a"]
GOLDEN = [
    ("space", [(0, 0.2574), (2, 0.2574), (12, 0.2574), (8, 0.2059), (3, 0.1287)]),
    ("dog", []),
    ("space odyssey", [(12, 0.5138), (0, 0.3213), (3, 0.1606), (2, 0.1287), (8, 0.1030)]),
    ("space AND odyssey", [(12, 0.5138), (0, 0.3213), (3, 0.1606)]),
    ('"space odyssey"', [(12, 0.5138), (0, 0.3213), (3, 0.1606)]),
    ('"2001: A Space Odyssey"', [(0, 0.5385), (3, 0.1882)]),
    ("Space AND Odyssey AND Kubrik", [(3, 0.2170)]),
    ('"Full Metal Jacket"', [(7, 0.4865), (3, 0.2432)]),
    ('"clockwork orange"', [(9, 0.9730)]),
    ("clockwork orange", [(9, 0.9730), (10, 0.6486)]),
    ('"Killer\'s Kiss"', [(4, 0.6486)]),
    ("killer kiss", [(4, 0.6486), (5, 0.4865)]),
    ("(space AND odyssey) OR orange", [(12, 0.3425), (9, 0.3243), (10, 0.2162), (0, 0.2142), (3, 0.1071)]),
    ("space OR (orange AND kiss) AND kubrik", [(3, 0.1146), (0, 0.0644), (2, 0.0644), (12, 0.0644), (8, 0.0515)]),
    ("(kiss AND killer) AND (danger OR full)", [(4, 0.7257)]),
    ("test test test space", [(13, 1.3195), (0, 0.0644), (2, 0.0644), (12, 0.0644), (8, 0.0515), (3, 0.0322)]),
    ("ki*", [(4, 1.2973), (5, 0.9730)]),
    ("*er", [(4, 1.5283), (5, 1.1462), (12, 0.6598)]),
    ('"*er ki*"', [(4, 0.8797), (5, 0.6598)]),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def stemmed(pages):
    i = index.build(pages, STOP, stem=True)
    i.postings = i.postings.cache()
    return i


def test_golden_batch(pages, stemmed):
    got = {}
    for r in search.search(stemmed, [(k, q) for k, (q, _) in enumerate(GOLDEN)], STOP, search.surface_vocabulary(pages, STOP)).collect():
        got.setdefault(r.qid, []).append((r.rank, r.doc_id, r.score))
    for k, (q, expected) in enumerate(GOLDEN):
        rows = sorted(got.get(k, []))
        assert [(d, pytest.approx(s, abs=6e-5)) for _, d, s in rows] == expected, q


def test_index_facts(stemmed):
    df = {r.term: r.df for r in index.document_frequency(stemmed.postings).collect()}
    assert (len(df), stemmed.postings.count(), stemmed.n_docs) == (37, 50, 14)
    assert {t: n for t, n in df.items() if n > 1} == {"space": 5, "odyssei": 3, "2001": 2, "metal": 2, "jacket": 2, "killer": 2, "kiss": 2, "clockwork": 2, "orang": 2}


def test_index_write_and_read(spark, stemmed, tmp_path):
    stemmed.write(str(tmp_path))
    back = index.Index.read(spark, str(tmp_path))
    assert back.n_docs == 14 and back.stemmed
    assert {(r.term, r.doc_id) for r in back.postings.collect()} == {(r.term, r.doc_id) for r in stemmed.postings.collect()}


VOCABULARY = "at cat cap atter cip catter ape aper".split()


@pytest.mark.parametrize(
    "pattern, expected",
    [("*", VOCABULARY), ("*t", ["at", "cat"]), ("c*p", ["cap", "cip"]), ("a*", ["at", "atter", "ape", "aper"]), ("*r", ["atter", "aper", "catter"]), ("c*", ["cat", "catter", "cap", "cip"]), ("*t*", ["at", "atter", "cat", "catter"]), ("*a*", ["at", "atter", "ape", "aper", "cat", "catter", "cap"]), ("*er", ["atter", "aper", "catter"]), ("test*", []), ("aper", ["aper"])],
)
def test_wildcards(pattern, expected):
    import re

    assert sorted(w for w in VOCABULARY if re.search(to_regex(pattern), w)) == sorted(expected)


def test_porter(spark):
    known = dict(caresses="caress", ponies="poni", cats="cat", agreed="agre", plastered="plaster", motoring="motor", sing="sing", conflated="conflat", hopping="hop", falling="fall", filing="file", happy="happi", sky="sky", relational="relat", conditional="condit", vietnamization="vietnam", triplicate="triplic", hopefulness="hope", revival="reviv", adjustment="adjust", adoption="adopt", probate="probat", controll="control", roll="roll", odyssey="odyssei", orange="orang", yes="ye")
    assert {w: porter_stem(w) for w in known} == known
    rows = spark.createDataFrame([(w,) for w in known], "term string")
    assert {r.term: r.stem for r in porter_stems(rows).collect()} == known


def test_query_language():
    assert [qlang.classify(q) for q in ("a", "a b", '"a b"', "a AND b", "ORANGE juice", "a*", '"a* b"', '"a"')] == ["one_word", "free_text", "phrase", "boolean", "free_text", "wildcard", "wildcard_phrase", "phrase"]
    assert qlang.parse("a OR (b) AND (c)").tree == ("or", ("w", "a"), ("and", ("w", "b"), ("w", "c")))
    assert qlang.parse("the AND b", ["the"]).tree == ("and", ("w", None), ("w", "b"))
    for broken in ("(", ")", "a AND", "OR", "(a OR", "a ) b OR c", ""):
        qlang.parse(broken)


def test_sets(stemmed):
    docs = lambda q: {r.doc_id for r in search.search(stemmed, [(1, q)], STOP).collect()}
    both, either, one = docs("space AND odyssey"), docs("space OR odyssey"), docs("space")
    assert both <= one <= either
    assert docs('"space odyssey"') <= both
    assert docs("dog OR space") == one


def test_tf_sums_and_top_k(stemmed):
    assert stemmed.postings.agg({"tf": "sum"}).first()[0] == sum(r.n_tokens for r in stemmed.sizes.collect())
    assert [r.rank for r in search.search(stemmed, [(1, "space")], STOP, k=2).collect()] == [1, 2]


def test_empty_table(spark):
    i = index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert search.search(i, [(1, "a"), (2, '"a b"'), (3, "a*"), (4, "a AND b"), (5, '"a* b*"')]).count() == 0


def test_porter_examples_of_the_paper():
    """The examples of Porter (1980) that stand at the rules; each word has gone through all steps. Fixed values."""
    known = """caresses caress  ponies poni  ties ti  caress caress  cats cat  feed feed  agreed agre  disabled disabl  matting mat  mating mate  meeting meet
milling mill  messing mess  meetings meet  plastered plaster  bled bled  motoring motor  sing sing  conflated conflat  troubled troubl  sized size  hopping hop
tanned tan  falling fall  hissing hiss  fizzed fizz  failing fail  filing file  happy happi  sky sky  relational relat  conditional condit  rational ration
valenci valenc  digitizer digit  conformabli conform  radicalli radic  differentli differ  vileli vile  analogousli analog  vietnamization vietnam
predication predic  operator oper  feudalism feudal  decisiveness decis  hopefulness hope  callousness callous  formaliti formal  sensitiviti sensit
sensibiliti sensibl  triplicate triplic  formative form  formalize formal  electriciti electr  electrical electr  hopeful hope  goodness good  revival reviv
allowance allow  inference infer  airliner airlin  gyroscopic gyroscop  adjustable adjust  defensible defens  irritant irrit  replacement replac
adjustment adjust  dependent depend  adoption adopt  homologou homolog  communism commun  activate activ  angulariti angular  homologous homolog
effective effect  bowdlerize bowdler  probate probat  rate rate  cease ceas  controll control  roll roll  generalizations gener  oscillators oscil""".split()
    pairs = dict(zip(known[::2], known[1::2], strict=True))
    assert {w: porter_stem(w) for w in pairs} == pairs


def test_near_is_the_least_distance(spark):
    """The merge of sorted positions agrees with all pairs."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [([rng.randrange(200) for _ in range(rng.randrange(6))], [rng.randrange(200) for _ in range(rng.randrange(6))], rng.randrange(20)) for _ in range(300)]
    got = spark.createDataFrame(rows, "p array<int>, q array<int>, o int").select("p", "q", "o", search.near(F.col("p"), F.col("q"), F.col("o")).alias("near")).collect()
    assert all(r.near == any(abs(q - p - r.o) <= search.PROXIMITY for p in r.p for q in r.q) for r in got) and len({r.near for r in got}) == 2


def test_products_mean_the_tree():
    import itertools

    for text in ("a AND (b OR c)", "(a OR b) AND (c OR a)", "a OR (b AND (c OR d)) OR a AND b", "(a AND the) OR b", "the AND a"):
        tree = qlang.parse(text, ["the"]).tree
        products = qlang.products(tree)
        for there in itertools.product([False, True], repeat=4):
            have = dict(zip("abcd", there, strict=True))
            value = eval(qlang.as_sql(tree, lambda w: str(have[w])).replace("false", "False"))
            assert value == any(all(have[w] for w in p) for p in products)
    wide = " AND ".join(f"(x{i} OR y{i})" for i in range(8))
    assert qlang.products(qlang.parse(wide).tree) is None


def test_large_boolean_and_many_expansions(pages, stemmed, monkeypatch):
    """What does not fit into the common plan gives the same rows."""
    vocabulary = search.surface_vocabulary(pages, STOP)
    asked = [(1, "(space OR kiss) AND (odyssey OR killer)"), (2, "*er"), (3, '"*er ki*"')]
    run = lambda: sorted(map(tuple, search.search(stemmed, asked, STOP, vocabulary).collect()))
    together = run()
    monkeypatch.setattr(search, "PUSHED", 0)
    monkeypatch.setattr(qlang, "products", lambda tree: None)
    assert run() == together and {r[0] for r in together} == {1, 2, 3}


def test_strict_phrases(spark):
    i = index.build(spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb " + "x " * 20 + "cc"), (3, "aa x")], "doc_id long, text string"))
    docs = lambda q, strict: {r.doc_id for r in search.search(i, [(1, q)], strict=strict).collect()}
    assert docs('"aa bb cc"', False) == {1, 2} and docs('"aa bb cc"', True) == {1} and docs('"aa"', True) == {1, 2, 3}


def test_terms_reach_the_scan(spark, stemmed, pages, tmp_path):
    """Words, and what a wildcard stands for, are conditions of the scans of postings and of df; sizes need no join."""
    stemmed.write(str(tmp_path))
    back = index.Index.read(spark, str(tmp_path))
    for asked in ("space", "kub*", '"space odyssey"', "space AND kubrik"):
        plan = search.search(back, [(1, asked)], STOP, search.surface_vocabulary(pages, STOP))._jdf.queryExecution().toString()
        scans = [x for x in plan.split("== Physical Plan ==")[1].split("\n") if "FileScan" in x]
        assert len(scans) == 2 and all("PushedFilters" in x and "term" in x.split("PushedFilters")[1] for x in scans), asked
    assert {r.doc_id for r in search.lookup(back, "kiss").collect()} == {4, 5}


def test_ranks_by_ranges(pages, stemmed):
    asked = [(k, q) for k, (q, _) in enumerate(GOLDEN)]
    run = lambda **how: sorted(map(tuple, search.search(stemmed, asked, STOP, search.surface_vocabulary(pages, STOP), **how).collect()))
    assert run(by_ranges=True) == run() and run(by_ranges=True, k=2) == run(k=2)
