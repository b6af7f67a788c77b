"""Scans: dictionaries, query files, stopwords, pipe-separated pairs, page dumps in XML, and page tables."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas
from textloom.operators.index import Index
from textloom.operators.numbering import numbered


def read_lines(spark: SparkSession, path: str, column: str = "word") -> DataFrame:
    """One row for each line that is not empty."""
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias(column))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid (line number from 1, on through the files in order of their names) and query; the last line of a file needs no line end.

    Lines are numbered file by file and start where the files before end, so no file is read whole.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # rows of one block of a file follow each other in one partition
    lines = numbered(lines, "file", "block", "at", name="line")
    return lines.where("trim(value) <> ''").select((F.col("line") + 1).cast("int").alias("qid"), F.regexp_replace("value", "\r$", "").alias("query"))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).distinct()


def read_pairs(spark: SparkSession, path: str, schema=schemas.ANAGRAM) -> DataFrame:
    """Lines key|value; further separators belong to the value."""
    key, value = schema.names
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.substring_index("value", "|", 1).alias(key), F.expr("substr(value, instr(value, '|') + 1)").alias(value))


#: What an XML page may hold for us. Text may have attributes or not, and stand in the page or in its revision.
_PAGE = "id STRING, title STRING, text STRING, revision STRUCT<text: STRING>, _broken STRING"
#: The entities that XML itself defines; & comes last.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


_PAGE_END = "</page>"


def page_chunks(spark: SparkSession, path: str, stream: bool = False, files: int | None = None, ends: bool = True) -> DataFrame:
    """value, file, open: an XML dump cut behind each </page>. Files are split by byte ranges, and each task finds its place at the next such end.

    open: the chunk is the last of its file and no </page> stands behind it, which its text does not show: then the chunks of the file with an end each are as
    much longer than the file. The ends of files are found by a first look at them; streams, readers without ends, and compressed files take all as closed.
    """
    read = spark.readStream if stream else spark.read
    if files:
        read = read.option("maxFilesPerTrigger", files)
    rows = read.option("lineSep", _PAGE_END).text(path)
    file = F.col("_metadata.file_path").alias("file")
    if stream or not ends:
        return rows.select("value", file, F.lit(False).alias("open"))
    # rows of one block of a file follow each other in one partition
    rows = rows.select("value", file, F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"))
    ends = rows.groupBy("file", "size").agg(F.max("place").alias("last"), F.sum(F.octet_length("value") + len(_PAGE_END)).alias("read"))
    ends = ends.where(F.col("read") == F.col("size") + len(_PAGE_END)).select("file", "last")
    return rows.join(F.broadcast(ends), "file", "left").select("value", "file", F.coalesce(F.col("place") == F.col("last"), F.lit(False)).alias("open"))  # a row for each file


def _field(raw: Column, tag: str) -> Column:
    """What stands between the first <tag> and the next </tag>, whatever is between them; null where they are missing."""
    body = F.get(F.regexp_extract_all(raw, F.lit(f"(?s)<{tag}(?:\\s[^>]*)?(?<!/)>(.*?)</{tag}\\s*>"), F.lit(1)), F.lit(0))
    for entity, c in _ENTITIES.items():
        body = F.replace(body, F.lit(entity), F.lit(c))
    return body


def parse_pages(chunks: DataFrame) -> DataFrame:
    """id, title, text, problem, raw, file of every <page> of the chunks; also of a stream.

    Each page is parsed by itself, so a broken one takes nothing with it. problem: null for a good page, else `markup` (stray or missing tags, that
    of the page too, or a bare &), `no id`, `bad id` (no whole number), `no text`. Of `markup` pages those fields are recovered that have both their
    tags; what is missing is null. raw: the page as it stands in the file, null for a good one. Only the page's own id, the first, counts; its text is
    its own or that of its revision, with the markup in it.
    """
    parts = F.split("value", "<page(?=[\\s/>])")
    each = chunks.select("file", "open", F.size(parts).alias("n"), F.posexplode(parts).alias("i", "part")).where("i > 0")
    each = each.select("file", (F.col("open") | (F.col("i") + 1 < F.col("n"))).alias("inner"), F.concat(F.lit("<page"), "part", F.lit("</page>")).alias("raw"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreSurroundingSpaces": "false"}
    read = each.withColumn("x", F.from_xml("raw", _PAGE, options))
    broken = F.col("x._broken").isNotNull() | F.col("inner")
    own = {"id": F.col("x.id"), "title": F.col("x.title"), "text": F.coalesce("x.text", "x.revision.text")}
    read = read.select("file", "raw", broken.alias("broken"), *[F.when(broken, _field(F.col("raw"), c)).otherwise(v).alias(c) for c, v in own.items()])
    number = F.expr("try_cast(trim(id) AS BIGINT)")
    problem = F.when(F.col("broken"), F.lit("markup")).when(F.col("id").isNull(), F.lit("no id")).when(number.isNull(), F.lit("bad id")).when(F.col("text").isNull(), F.lit("no text"))
    return read.select(number.alias("id"), "title", "text", problem.alias("problem"), F.when(problem.isNotNull(), F.col("raw")).alias("raw"), "file")


def usable(parsed: DataFrame, recover: bool = True) -> DataFrame:
    """id, title, text of the good pages and, with recover, of the broken ones whose id and text are there."""
    return parsed.where("id is not null and text is not null" if recover else "problem is null").select("id", "title", "text")


def read_pages(spark: SparkSession, path: str, recover: bool = True) -> DataFrame:
    """id, title, text of each <page> of an XML dump that has an id and a text, broken pages too; recover=False: good ones only. valid_pages asks for a title too."""
    return usable(parse_pages(page_chunks(spark, path, ends=not recover)), recover)


def broken_pages(spark: SparkSession, path: str) -> DataFrame:
    """The quarantine: problem, raw and file of each page that is not good, with what could be recovered of it."""
    return parse_pages(page_chunks(spark, path)).where("problem is not null")


def stream_pages(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """doc_id, title, text of the pages of dumps that arrive in a folder, as a stream; files: of a batch at most."""
    return usable(parse_pages(page_chunks(spark, path, stream=True, files=files))).withColumnRenamed("id", "doc_id")


def valid_pages(pages: DataFrame) -> DataFrame:
    """Pages with an id, a title and a text."""
    return pages.where("id is not null and title is not null and text is not null")


def pages_of(table: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of texts as pages without titles."""
    return table.select(F.col(doc_id).alias("id"), F.lit(None).cast("string").alias("title"), F.col(text).alias("text"))


def html_pages(table: DataFrame) -> DataFrame:
    """id, title and text (tags removed) of a table page_id, html."""
    title = F.regexp_extract("html", "(?is)<title>([^<]*)</title>", 1)
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<[^>]*>", " "), "[ \t\r\n]+", " ")
    return table.select(F.col("page_id").alias("id"), F.trim(title).alias("title"), F.trim(text).alias("text"))


def read_index_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The line form of an index, as index_lines writes it: (term, doc_id, positions, tf, size, df; lines that are not of that form, with file and problem).

    Lines of one term may come in any order and number. A line with a posting that is no posting is given back whole and read in its other postings;
    one without a term, or without any posting, has none. df is that of the lines; a reader that asks for another counts.
    """
    lines = spark.read.text(path).where("value <> ''").select("value", F.col("_metadata.file_path").alias("file"))
    bar = F.expr("instr(value, '|')")
    lines = lines.select("value", "file", bar.alias("bar"), F.expr("substr(value, 1, greatest(instr(value, '|') - 1, 0))").alias("term"), F.expr("substr(value, instr(value, '|') + 1)").alias("rest"))
    parts = F.filter(F.split("rest", ";"), lambda p: p != "")
    good = F.filter(parts, lambda p: p.rlike(_POSTING))
    lines = lines.withColumn("all", F.size(parts)).withColumn("good", good)
    problem = F.when((F.col("bar") == 0) | (F.col("term") == ""), F.lit("no term")).when(F.col("all") == 0, F.lit("no posting")).when(F.size("good") < F.col("all"), F.lit("bad posting"))
    bad = lines.select(problem.alias("problem"), F.col("value").alias("line"), "file").where("problem is not null")
    # lines are exchanged, not postings, and once: those of a term stay together for all that is grouped or joined by it
    each = lines.where(~F.coalesce(problem == "no term", F.lit(False))).select("term", "rest").repartition("term").select("term", F.explode(good).alias("p"))
    at = lambda k: F.regexp_extract("p", _POSTING, k)
    rows = each.select("term", at(1).cast("long").alias("doc_id"), F.split(at(5), ",").cast("array<int>").alias("positions"), at(2).cast("int").alias("tf"), at(3).cast("int").alias("size"), at(4).cast("long").alias("df"))
    # a posting that stands in several lines is one, with the positions of all
    rows = rows.groupBy("term", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"), F.max("size").alias("size"), F.max("df").alias("df"))
    return rows.select("term", "doc_id", "positions", F.size("positions").alias("tf"), "size", "df"), bad


#: doc:tf/size/df:p1,p2. The repeat of positions is possessive: Java goes through any other repeat of a group by recursion, and some 2,000 positions end its stack and with it the executor.
_POSTING = r"^(-?\d{1,18}):(\d{1,9})/(\d{1,9})/(\d{1,18}):(\d{1,9}(?:,\d{1,9})*+)$"


def index_of_lines(spark: SparkSession, path: str, n_docs: int, stemmed: bool = False) -> Index:
    """An index that is read from lines; n_docs, which they do not hold, is its number of pages."""
    rows, _ = read_index_lines(spark, path)
    sizes = rows.groupBy("doc_id").agg(F.max("size").alias("n_tokens"), F.count("*").cast("int").alias("n_terms"))
    postings = rows.select("term", "doc_id", "positions", "tf", F.col("size").alias("n_tokens"))
    return Index(postings, sizes, n_docs, stemmed, "n_tokens")


#: Terms up to which files are chosen by the scan of their ranges; beyond, by the driver, from those between the least and the greatest.
CHOSEN = 200


def read_sizes(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """doc_id, n_tokens, n_terms: the rows without a term of the files that write_index wrote of laid-out postings."""
    return spark.read.schema(f"term string, doc_id {id_type}, n_tokens int, n_terms int").parquet(f"{path}/postings").where("term is null").drop("term")


def read_postings(spark: SparkSession, path: str, schema: str, terms: list[str] | None = None) -> DataFrame:
    """Postings that write_index wrote; with terms, of the files only that may hold one of them."""
    if terms is None:
        return spark.read.schema(schema).parquet(f"{path}/postings").where("term is not null")
    terms, files = sorted(set(terms)), spark.read.schema("file string, low string, high string").parquet(f"{path}/files")
    if not terms:
        return spark.createDataFrame([], schema)
    if len(terms) <= CHOSEN:
        here = reduce(Column.__or__, [(F.col("low") <= t) & (F.col("high") >= t) for t in terms])
        names = [r.file for r in files.where(here).select("file").collect()]
    else:
        near = files.where((F.col("high") >= terms[0]) & (F.col("low") <= terms[-1])).collect()
        order = [t.encode() for t in terms]
        names = [r.file for r in near if (i := bisect_left(order, r.low.encode())) < len(order) and order[i] <= r.high.encode()]
    return spark.read.schema(schema).parquet(*[f"{path}/postings/{n}" for n in names]) if names else spark.createDataFrame([], schema)
