"""Sinks: line forms of indexes and results, and postings as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.terms import Layout, unpacker
from textloom.functions.text import clean_words, strip_templates
from textloom.functions.wildcard import starts

#: Documents in a part of a term's line.
LINE_DOCS = 100_000
#: Bytes of a row group of grams: a lookup reads whole ones.
GRAM_BLOCK = 4 << 20
#: Terms whose grams are sorted together: about 11 grams each.
GRAM_TERMS = 250_000


def anagram_lines(index: DataFrame) -> DataFrame:
    """key|word in the order of whole lines."""
    return index.select(F.concat_ws("|", "akey", "word").alias("line")).orderBy("line")


def match_lines(found: DataFrame) -> DataFrame:
    """qid and m1|m2| for each query; empty where nothing matches."""
    return found.select("qid", F.array_join(F.transform("matches", lambda m: F.concat(m, F.lit("|"))), "").alias("line"))


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("id", F.format_string("page %d: %s", "id", "text").alias("line"))


def title_lines(pages: DataFrame) -> DataFrame:
    return pages.where("title is not null and title <> ''").select("id", F.concat_ws("|", F.col("id").cast("string"), "title").alias("line"))


def index_lines(weights: DataFrame, docs: int = LINE_DOCS) -> DataFrame:
    """term, part and the line term|doc:tf/size/df:p1,p2;... in document order. A part holds the numbers that doc_id runs through from part * docs on, docs of them, so no line is unbounded."""
    one = F.concat(F.col("doc_id"), F.lit(":"), F.col("tf"), F.lit("/"), F.col("size"), F.lit("/"), F.col("df"), F.lit(":"), F.array_join(F.col("positions").cast("array<string>"), ","), F.lit(";"))
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", one.alias("p"))))
    lines = weights.groupBy("term", F.floor(F.col("doc_id") / docs).cast("long").alias("part")).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("p"))
    return lines.select("term", "part", F.concat("term", F.lit("|"), "p").alias("line"))


def whole_lines(weights: DataFrame, docs: int = LINE_DOCS) -> DataFrame:
    """term and its one line: the parts of index_lines, in order, so that a task holds the postings of a part and the texts of a term's parts."""
    body = F.struct("part", F.expr("substr(line, length(term) + 2)").alias("p"))
    whole = index_lines(weights, docs).groupBy("term").agg(F.array_sort(F.collect_list(body)).alias("parts"))
    return whole.select("term", F.concat("term", F.lit("|"), F.array_join(F.transform("parts", lambda x: x["p"]), "")).alias("line"))


def result_lines(results: DataFrame, separator: str = ", ") -> DataFrame:
    """query => d1, d2, ... by rank; one row for each query with results."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    ids = F.transform(ordered, lambda x: x["doc_id"].cast("string"))
    return results.groupBy("qid", "query").agg(F.array_join(ids, separator).alias("ids")).select("qid", F.concat("query", F.lit(" => "), "ids").alias("line"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages whose text has lost its templates, then its unclean words; other columns stay."""
    return pages.withColumn("text", clean_words(strip_templates("text")))


def xml_lines(pages: DataFrame, closing: bool = True) -> DataFrame:
    """Pages, which clean_pages cleans, as balanced XML lines; closing=False leaves out the end tags of fields."""
    def field(name):
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>" if closing else ""))

    lines = F.array(F.lit("<page>"), field("id"), field("title"), field("text"), F.lit("</page>"))
    return pages.select("id", F.array_join(lines, "\n").alias("line"))


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    lines.select("line").write.mode("overwrite").option("compression", compression).text(path)


def write_index(postings: DataFrame, path: str, layout: Layout | None = None) -> None:
    """postings/: files in order of (term, doc_id), each a range of them, so a term in every text spreads over several; files/: the range of terms of each.

    A lookup reads the few rows of files/ that its terms are in, opens those files, and of them the row groups and pages that may hold the terms. layout: of
    postings that are packed by it (index.laid_out); rows without a term then tell the sizes of documents.
    """
    spark = postings.sparkSession
    if layout is None:
        dealt = postings.repartitionByRange("term", "doc_id")
    else:
        columns = f"term string, doc_id {layout.id_type}, positions array<int>, tf int, n_tokens int, n_terms int"
        dealt = postings.repartitionById(layout.files, F.col("file")).mapInArrow(unpacker(layout), columns)
    dealt.sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    terms = spark.read.parquet(f"{path}/postings").select("term", F.col("_metadata.file_name").alias("file"))
    ranges = terms.groupBy("file").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    ranges.orderBy("low", "high").write.mode("overwrite").parquet(f"{path}/files")


def write_terms(terms: DataFrame, path: str) -> None:
    """The vocabulary with df, sorted, and its grams, in files for ranges of terms, each sorted, so that words need a row group or two, and wildcards a few pages of each file.

    Terms are exchanged for the grams, not the grams, of which there are ten times as many.
    """
    terms.select("term", "df").orderBy("term").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")
    stored = terms.sparkSession.read.parquet(f"{path}/terms")
    parts = max(1, -(-stored.count() // GRAM_TERMS), min(stored.count() // 10_000, terms.sparkSession.sparkContext.defaultParallelism))
    dealt = stored.select("term").repartitionByRange(parts, "term")
    starts(dealt).sortWithinPartitions("gram", "term").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GRAM_BLOCK).parquet(f"{path}/grams")
