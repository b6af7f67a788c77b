"""Positional inverted index: postings, statistics, weights, and upsert."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.terms import COLUMNS, Layout, cells, packer, splitter
from textloom.functions.wildcard import to_regex
from textloom.shared import BROADCAST_ROWS, ship_package, staged


def _quoted(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def among(values: list[str], ranges: dict[str, list[tuple[int, int]]] | None = None):
    """The condition that term is one of values and doc_id in its ranges, if it has any given: one expression, however many there are."""
    if not values:
        return F.lit(False)
    free = [v for v in values if ranges is None or v not in ranges]
    parts = [f"term in ({', '.join(map(_quoted, free))})"] if free else []
    for v in values:
        if ranges is not None and v in ranges:
            parts.append(f"(term = {_quoted(v)} and ({' or '.join(f'doc_id between {a} and {z}' for a, z in ranges[v]) or 'false'} or doc_id is null))")
    return F.expr(" or ".join(parts))


#: Ranges of doc_id in the table of blocks, and numbers of a range at least.
BLOCKS, BLOCK_DOCS = 4096, 64
#: Postings of a file of a stored index, and texts of whose terms the bounds of its files are taken.
FILE_ROWS, SAMPLED = 400_000, 500
#: Terms that are indexed; longer ones count in the size of a document only.
SHORT = f"length(term) < {T.MAX_TERM}"


@dataclass
class Index:
    """postings: term, doc_id, positions, tf, and the sizes of the document, n_tokens and n_terms. sizes: doc_id, n_tokens, n_terms.

    n_docs: pages, with tokens or not. terms: term, df, where they are stored; else they are counted.
    grams: gram, term (wildcard.gram_table), where they are stored. blocks: see plans/blocks.py.
    reader: postings of the given terms only: from the files that may hold them, or split from the texts, which then takes patterns too. source: what write() stores, split from the texts.
    """

    postings: DataFrame
    sizes: DataFrame
    n_docs: int
    stemmed: bool = False
    size: str = "n_tokens"
    terms: DataFrame | None = None
    grams: DataFrame | None = None
    blocks: DataFrame | None = None
    reader: Callable[[list[str]], DataFrame] | None = None
    source: Callable[[], tuple[DataFrame, Layout]] | None = None

    def of(self, terms: list[str], ranges: dict[str, list[tuple[int, int]]] | None = None) -> DataFrame:
        """Postings of these terms (in these ranges of doc_id, by term): only files that may hold them are opened, and all conditions reach their scans."""
        p = self.postings if self.reader is None else self.reader(terms)
        return p.where(among(terms, ranges))

    def weights(self, terms: list[str] | DataFrame | None = None, ranges: dict[str, list[tuple[int, int]]] | None = None) -> DataFrame:
        """term, doc_id, positions, tf, size, df, tfidf = tf / size * ln(N / df). terms: only these are read; a list is pushed into the scans."""
        p, stored = self.postings, self.terms
        if isinstance(terms, DataFrame):
            p = p.join(terms, "term", "left_semi")
        elif terms is not None:
            p = self.of(terms, ranges if stored is not None else None)  # else df is counted from what is read
            stored = None if stored is None else F.broadcast(stored.where(among(terms)))  # as many rows as the list
        df = document_frequency(p) if stored is None else stored
        if terms is None and self.reader is not None and self.source is None:  # postings that stand in files
            w = _often_and_seldom(p, df if stored is not None else staged(df, "df"))
        else:
            w = p.join(df, "term")
        w = w.select("term", "doc_id", "positions", "tf", F.col(self.size).alias("size"), "df")
        return w.withColumn("tfidf", F.col("tf") / F.col("size") * F.log(F.lit(float(max(1, self.n_docs))) / F.col("df")))

    def narrowed(self, words: list[str], patterns: list[str]) -> Index:
        """The index of what queries of these words and patterns may read. Where nothing is stored, texts are read once for them all and the postings are written."""
        if self.reader is None or self.terms is not None or self.grams is not None:
            return self
        p = staged(self.reader(words, patterns), "asked")
        return replace(self, postings=p, terms=staged(document_frequency(p), "asked-terms"), reader=None)

    def vocabulary(self) -> DataFrame:
        return self.postings.select("term").distinct() if self.terms is None else self.terms.select("term")

    def write(self, path: str) -> None:
        """All else is made of the postings as they stand in order on disk. Texts are split once, for postings and sizes alike."""
        from textloom.sources.readers import read_sizes
        from textloom.sources.writers import write_index, write_terms

        spark = self.postings.sparkSession
        if self.source is None:
            write_index(self.postings, path)
        else:
            rows, layout = self.source()
            write_index(rows, path, layout)
        p = spark.read.schema(self.postings.schema).parquet(f"{path}/postings").where("term is not null")
        write_terms(document_frequency(p), path)
        sizes = self.sizes if self.source is None else read_sizes(spark, path, p.schema["doc_id"].dataType.simpleString())
        sizes.select("doc_id", "n_tokens", "n_terms").write.mode("overwrite").parquet(f"{path}/sizes")
        span = p.agg(F.min("doc_id"), F.max("doc_id")).first()
        width = max(BLOCK_DOCS, -(-(span[1] - span[0] + 1) // BLOCKS)) if span[0] is not None else BLOCK_DOCS
        ship_package(spark)
        rows = p.select("term", "doc_id", "tf", self.size).mapInArrow(cells(span[0] or 0, width, self.size), "term string, block int, n long, first long, last long, best double")
        rows.write.mode("overwrite").parquet(f"{path}/blocks")
        meta = spark.createDataFrame([(self.n_docs, self.stemmed, self.size)], "n_docs long, stemmed boolean, size string")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        meta = spark.read.parquet(f"{path}/meta").first()
        from textloom.sources.readers import read_postings

        table = lambda name: spark.read.parquet(f"{path}/{name}")
        postings = table("postings").where("term is not null")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in postings.schema)
        return cls(postings, table("sizes"), meta["n_docs"], meta["stemmed"], meta["size"], table("terms"), grams=table("grams"), blocks=table("blocks"), reader=lambda terms: read_postings(spark, path, kinds, terms))


def postings(tokens: DataFrame) -> DataFrame:
    """term, doc_id, positions, tf of tokens (text.tokens)."""
    each = tokens.where(SHORT).groupBy("term", "doc_id")
    return each.agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").cast("int").alias("tf"))


def _texts(docs: DataFrame, single: bool, dealt: bool) -> DataFrame:
    """doc_id, texts, dealt out by doc_id: a row for each that has one text, or more. single: no doc_id comes twice. dealt: rows stand where they may stay."""
    rows = docs.select("doc_id", "text").where("text is not null")
    if single:
        dealt = dealt or len(docs.inputFiles()) >= docs.sparkSession.sparkContext.defaultParallelism  # files enough for all cores
        return (rows if dealt else rows.repartition("doc_id")).select("doc_id", F.array("text").alias("texts"))
    return rows.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


def _counted(docs: DataFrame) -> tuple[int, bool]:
    """Rows of docs, and whether each has a doc_id of its own."""
    n = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return n[0], n[1] <= 1


def _mapped(docs: DataFrame, single: bool | None, dealt: bool, columns: str, **how) -> DataFrame:
    if single is None:
        single = _counted(docs)[1]
    ship_package(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs, single, dealt).mapInArrow(splitter(**how), columns.format(id_type))


def sized_terms(docs: DataFrame, stopwords: list[str] | None = None, stem: bool = False, single: bool | None = None, dealt: bool = False, words: list[str] | None = None, patterns: list[str] = ()) -> DataFrame:
    """term, doc_id, positions, tf of all terms of docs (doc_id, text) with the sizes of their document; with words, of these and those that fit patterns.

    Each text is split by itself where it was dealt to: texts move once, terms not at all. single: no doc_id comes twice, which else is counted.
    """
    columns = "term string, doc_id {}, positions array<int>, tf int, n_tokens int, n_terms int"
    return _mapped(docs, single, dealt, columns, stopwords=stopwords, stem=stem, words=words, patterns=[to_regex(p) for p in patterns])


def sizes(docs: DataFrame, stopwords: list[str] | None = None, stem: bool = False, single: bool | None = None, dealt: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_terms of the texts with a token: all tokens, also those too long for the index, and distinct indexed terms."""
    return _mapped(docs, single, dealt, "doc_id {}, n_tokens int, n_terms int", stopwords=stopwords, stem=stem, sizes=True)


def laid_out(docs: DataFrame, stopwords: list[str] | None = None, stem: bool = False, single: bool | None = None, dealt: bool = False, old: DataFrame | None = None) -> tuple[DataFrame, Layout]:
    """sized_terms, without those too long for the index and with a row without a term for each text, packed by the file that they go to (terms.packed); and the layout that tells it.

    Files are to hold FILE_ROWS postings, and their bounds are quantiles of the postings of about SAMPLED texts; all texts are indexed, a bad sample makes uneven files only.
    old: stored rows of other documents that are to stand in the same files (see relaid).
    """
    n, counted = _counted(docs)
    single = counted if single is None else single
    n += 0 if old is None else old.where("term is null").count()
    some = sized_terms(docs.select("doc_id", "text").where(_among(n)), stopwords, stem, single, dealt=True).where(SHORT).select("term", "doc_id")
    layout = _layout(docs, n, some if old is None else some.unionByName(old.where(_among(n) & F.col("term").isNotNull()).select("term", "doc_id")))
    rows = _mapped(docs, single, dealt, PACK, stopwords=stopwords, stem=stem, layout=layout)
    return rows if old is None else rows.unionByName(old.select(*COLUMNS).mapInArrow(packer(layout), PACK)), layout


def relaid(rows: DataFrame, n: int) -> tuple[DataFrame, Layout]:
    """As laid_out for stored rows: postings with the sizes of their document and, perhaps, a row without a term for each document. n: documents."""
    ship_package(rows.sparkSession)
    layout = _layout(rows, n, rows.where(_among(n) & F.col("term").isNotNull()).select("term", "doc_id"))
    return rows.select(*COLUMNS).mapInArrow(packer(layout), PACK), layout


PACK = "file int, rows binary"


def _among(n: int) -> Column:
    """Rows of about SAMPLED of n documents."""
    return (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLED))) == 0) & F.col("doc_id").isNotNull()


def _layout(of: DataFrame, n: int, sample: DataFrame) -> Layout:
    """Files for the postings of n documents, of which sample has those of _among. of: a table with doc_id."""
    found = sorted(tuple(r) for r in sample.collect())
    files = max(-(-len(found) * max(1, n // SAMPLED) // FILE_ROWS), of.sparkSession.sparkContext.defaultParallelism)
    quantiles = lambda rows, n: tuple(sorted({rows[k * len(rows) // n] for k in range(1, n)})) if rows else ()
    return Layout(quantiles(found, files), quantiles(sorted({d for _, d in found}), -(-n // FILE_ROWS)), of.schema["doc_id"].dataType.simpleString())


def doc_postings(docs: DataFrame, single: bool | None = None) -> DataFrame:
    """term, doc_id, positions, tf of docs."""
    return sized_terms(docs, single=single).where(SHORT).select("term", "doc_id", "positions", "tf")


def build(docs: DataFrame, stopwords: list[str] | None = None, stem: bool = False, size: str = "n_tokens") -> Index:
    """docs: doc_id, text. What is asked of the index splits the texts anew, and only terms that are asked for leave their tasks; write() stores all."""
    n, single = _counted(docs)
    only = lambda words, patterns=(): sized_terms(docs, stopwords, stem, single, words=words, patterns=patterns).where(SHORT)
    return Index(only(None), sizes(docs, stopwords, stem, single), n, stem, size, reader=only, source=lambda: laid_out(docs, stopwords, stem, single))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings of both: positions of equal (term, doc_id) united, in order."""
    both = old.select("term", "doc_id", "positions").unionByName(new.select("term", "doc_id", "positions"))
    merged = both.groupBy("term", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return merged.select("term", "doc_id", "positions", F.size("positions").alias("tf"))


def _often_and_seldom(rows: DataFrame, df: DataFrame) -> DataFrame:
    """rows with the df of their term. The terms that most rows have, BROADCAST_ROWS at most, go by broadcast; only rows of the others are exchanged, for which rows are read twice."""
    counts = df.agg(*[F.count_if(F.col("df") >= 1 << k) for k in range(48)]).first()
    k = next(k for k, n in enumerate(counts) if n <= BROADCAST_ROWS)
    often = F.broadcast(df.where(F.col("df") >= 1 << k))
    out = rows.join(often, "term")
    return out.unionByName(rows.join(often, "term", "left_anti").join(df.where(F.col("df") < 1 << k).hint("merge"), "term")) if k else out


def document_frequency(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count("*").alias("df"))


def inverse_document_frequency(postings_: DataFrame, n_docs: int) -> DataFrame:
    return document_frequency(postings_).select("term", F.log(F.lit(float(max(1, n_docs))) / F.col("df")).alias("idf"))


def prefix_counts(vocabulary: DataFrame, column: str = "term") -> DataFrame:
    """prefix, load (terms with it), finished (terms equal to it): the counters of a trie."""
    each = vocabulary.select(column, F.explode(F.sequence(F.lit(1), F.length(column))).alias("n"))
    prefix = F.expr(f"substr({column}, 1, n)")
    return each.select(prefix.alias("prefix"), (F.col("n") == F.length(column)).alias("ends")).groupBy("prefix").agg(F.count("*").alias("load"), F.count_if("ends").alias("finished"))
