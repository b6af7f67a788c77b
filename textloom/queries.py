"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import anagram, index, kv, kv_store, numbering
from textloom.plans import blocks, table
from textloom.plans import search as S
from textloom.shared import fresh_path, small_side
from textloom.sources import cleaner, readers, segments, writers
from textloom.streaming import incremental

#: Words of four languages that stand for a stopword list in these queries.
STOP = ["the", "of", "and", "to", "in", "a", "is", "it", "de", "la", "que", "der", "die", "und"]
BATCH = [
    (1, "that"), (2, "thth"), (3, "that with"), (4, "that AND with"), (5, '"that this"'), (6, "(that AND was) OR keit"),
    (7, "with OR (this AND are) AND was"), (8, "heit*"), (9, "*chkeit"), (10, '"th* *nd"'), (11, "that that with"), (12, "zzzzz"),
]

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _index(spark: SparkSession, d: str, stop=None) -> index.Index:
    return index.build(_docs(spark, d), stop)


def _text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


IN_STOP = ", ".join(f"'{s}'" for s in STOP)


def _tok(table: str = "documents", stop: bool = False, doc: str = "doc_id", text: str = "text", where: str = "true") -> str:
    keep = f"WHERE raw NOT IN ({IN_STOP})" if stop else ""
    return rf"""
raw AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS ord FROM (SELECT {doc} AS doc_id, string_split_regex({text}, '[ \n\t<]') AS p FROM {table} WHERE {text} IS NOT NULL AND {where})),
tok AS (SELECT doc_id, ord - 1 AS ord, pos, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS term FROM (SELECT *, (sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS pos FROM raw {keep})),
tokens AS (SELECT * FROM tok WHERE term <> ''),
postings AS (SELECT term, doc_id, list(pos ORDER BY pos) AS positions, count(*)::INT AS tf FROM tokens WHERE length(term) < 25 GROUP BY term, doc_id),
sizes AS (SELECT doc_id, count(*)::INT AS n_tokens, count(DISTINCT CASE WHEN length(term) < 25 THEN term END)::INT AS n_terms FROM tokens GROUP BY doc_id),
n AS (SELECT count(*) AS n FROM {table}),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
weights AS (SELECT p.term, p.doc_id, positions, tf, n_tokens AS size, df, tf / n_tokens * ln(n.n / df) AS tfidf FROM postings p JOIN df USING (term) JOIN sizes USING (doc_id), n)"""


TOK, TOK_STOP = _tok(), _tok(stop=True)
#: Documents with the titles of the pages of the same number.
TITLED = r"tt AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) AS title FROM pages), titled AS (SELECT doc_id AS id, title, text FROM documents LEFT JOIN tt ON page_id = doc_id)"


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """id, title, text: the documents, with the titles of the pages of the same number."""
    titles = readers.html_pages(spark.read.parquet(f"{d}/pages.parquet")).select("id", "title")
    return readers.pages_of(_docs(spark, d)).drop("title").join(titles, "id", "left").select("id", "title", "text")
KEY = "array_to_string(list_sort(string_split({0}, '')), '')"


# ---- sources, sinks, projections
@query(f"SELECT {KEY.format('p_name')} AS akey, p_name AS word, {KEY.format('p_name')} || '|' || p_name AS line FROM part WHERE p_name <> ''")
def anagram_index(spark, d):
    words = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("word"))
    return anagram.anagram_index(words).select("akey", "word", F.concat_ws("|", "akey", "word").alias("line"))


@query(f"SELECT {KEY.format('p_name')} AS akey, p_name AS word FROM part WHERE p_name <> ''")
def anagram_file(spark, d):
    """The anagram index as a file of pairs, read back."""
    path = fresh_path(spark, "pairs")
    words = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("word"))
    writers.write_lines(writers.anagram_lines(anagram.anagram_index(words)), path)
    return readers.read_pairs(spark, path)


VOCAB_SQL = f"WITH {TOK}, v AS (SELECT DISTINCT term AS word FROM tokens WHERE length(term) < 25), k AS (SELECT {KEY.format('word')} AS akey, word FROM v)"
ASKED_SQL = "q AS (SELECT reverse(word) AS query FROM v UNION ALL SELECT word || '?' FROM v WHERE length(word) = 7)"


@query(VOCAB_SQL + f", {ASKED_SQL}, f AS (SELECT query, list(word ORDER BY word) FILTER (word IS NOT NULL) AS m FROM q LEFT JOIN k ON k.akey = {KEY.format('query')} GROUP BY query) SELECT query, coalesce(array_to_string(m, ','), '') AS matches, coalesce(array_to_string([x || '|' FOR x IN m], ''), '') AS line FROM f")
def anagram_lookup(spark, d):
    """Every word of the vocabulary is asked backwards, and some queries that match nothing."""
    words = T.tokens(_docs(spark, d)).where(F.length("term") < T.MAX_TERM).select(F.col("term").alias("word")).distinct()
    asked = words.select(F.reverse("word").alias("query")).unionByName(words.where(F.length("word") == 7).select(F.concat("word", F.lit("?")).alias("query")))
    found = anagram.anagram_lookup(asked.withColumn("qid", F.xxhash64("query")), anagram.anagram_index(words))
    return found.select("query", F.array_join("matches", ",").alias("matches"), F.array_join(F.transform("matches", lambda m: F.concat(m, F.lit("|"))), "").alias("line"))


@query(f"SELECT row_number() OVER (ORDER BY {KEY.format('p_name')} || '|' || p_name) - 1 AS place, {KEY.format('p_name')} || '|' || p_name AS line FROM part WHERE p_name <> ''")
def anagram_order(spark, d):
    """The lines of the anagram index with their places in the sorted file."""
    words = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("word"))
    return numbering.numbered(writers.anagram_lines(anagram.anagram_index(words)), "line", name="place")


@query(f"WITH {TOK} SELECT doc_id, ord, term FROM tokens")
def tokenize(spark, d):
    return T.tokens(_docs(spark, d)).select("doc_id", F.col("ord").cast("long").alias("ord"), "term")


@query(f"WITH {TOK} SELECT doc_id, ord, pos, term FROM tokens WHERE length(term) < 25")
def positions(spark, d):
    return T.tokens(_docs(spark, d)).where(F.length("term") < T.MAX_TERM).select("doc_id", F.col("ord").cast("long").alias("ord"), "pos", "term")


@query(f"WITH {TOK_STOP} SELECT doc_id, ord, pos, term FROM tokens")
def stopword_filter(spark, d):
    return T.tokens(_docs(spark, d), STOP).select("doc_id", F.col("ord").cast("long").alias("ord"), "pos", "term")


@query(r"""SELECT doc_id, array_to_string([w FOR w IN [translate(regexp_replace(split_part(x, '&', 1), '[^A-Za-z0-9''",.|]', '', 'g'), '|', ' ') FOR x IN string_split(text, ' ')] IF w <> '' AND length(w) < 20], ' ') AS cleaned FROM documents WHERE text IS NOT NULL""")
def clean_words(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.clean_words("text").alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(text, '(?s)\{[^}]*\}.?', '', 'g') AS stripped FROM documents WHERE text IS NOT NULL")
def strip_templates(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.strip_templates("text").alias("stripped"))


NORMAL = r"lower(regexp_replace(regexp_replace(coalesce(title, '') || coalesce(text, ''), '[^A-Za-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
NORMALISED = f"normal AS (SELECT id, array_to_string([w FOR w IN string_split({NORMAL}, ' ') IF w <> '' AND w NOT IN ({IN_STOP})], ' ') AS text FROM titled)"


@query(f"WITH {TITLED}, {NORMALISED} SELECT id, text FROM normal")
def normalize_page(spark, d):
    return T.normalise_pages(_titled(spark, d), STOP)


@query(r"SELECT page_id AS id, trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) AS title, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def page_extract(spark, d):
    return readers.html_pages(spark.read.parquet(f"{d}/pages.parquet"))


@query(r"WITH p AS (SELECT page_id AS id, trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) AS title FROM pages) SELECT id, id || '|' || title AS line FROM p WHERE title <> ''")
def page_titles(spark, d):
    return writers.title_lines(readers.html_pages(spark.read.parquet(f"{d}/pages.parquet")))


@query(f"WITH {TITLED}, {NORMALISED} SELECT id, 'page ' || id || ': ' || text AS line FROM normal")
def page_lines(spark, d):
    """The lines of the page normaliser: title and text of each page."""
    return writers.page_lines(T.normalise_pages(_titled(spark, d), STOP))


@query(r"WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z0-9]+)', 1)) AS tag FROM pages) SELECT lower(tag) AS tag, count(*) AS n FROM t WHERE regexp_matches(lower(tag), '^(id|title|text|page)') GROUP BY 1")
def good_tags(spark, d):
    tags = spark.read.parquet(f"{d}/pages.parquet").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z0-9]+)"), F.lit(1))).alias("tag")).select(F.lower("tag").alias("tag"))
    return tags.where(T.is_good_tag("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id AS id, trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) AS title, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages),
s AS (SELECT id, title, regexp_replace(text, '(?s)\{[^}]*\}.?', '', 'g') AS text FROM p),
c AS (SELECT id, title, array_to_string([w FOR w IN [translate(regexp_replace(split_part(x, '&', 1), '[^A-Za-z0-9''",.|]', '', 'g'), '|', ' ') FOR x IN string_split(text, ' ')] IF w <> '' AND length(w) < 20], ' ') AS text FROM s)
SELECT id, '<page>' || chr(10) || '<id>' || id || '</id>' || chr(10) || '<title>' || title || '</title>' || chr(10) || '<text>' || text || '</text>' || chr(10) || '</page>' AS line FROM c""")
def xml_clean_sink(spark, d):
    """The whole XML cleaner: templates out, words cleaned, then the lines."""
    return writers.xml_lines(writers.clean_pages(readers.html_pages(spark.read.parquet(f"{d}/pages.parquet"))))


@query(_SQL["xml_clean_sink"].replace(" || '</id>'", "").replace(" || '</title>'", "").replace(" || '</text>'", ""))
def xml_sink(spark, d):
    """The same pages without the end tags of fields."""
    return writers.xml_lines(writers.clean_pages(readers.html_pages(spark.read.parquet(f"{d}/pages.parquet"))), closing=False)


#: Titles of a few words that are broadcast, some 100 bytes each, before all postings are exchanged instead.
TITLES = 4_000_000


def _dump(spark, d, files: int | None = None) -> str:
    """The documents as an XML dump: pages with attributes at the text, other ids inside, and every fifth page without a title. files: how many."""
    pages = readers.pages_of(_docs(spark, d).where("text is not null")).withColumn("title", F.when(F.col("id") % 5 != 0, F.concat(F.lit("Page "), "id")))
    inner = F.struct((F.col("id") + 7).alias("id")).alias("revision"), F.struct(F.col("text").alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")
    path = fresh_path(spark, "dump")
    if files:  # texts are exchanged only if there are too few tasks
        pages = pages.coalesce(files) if pages.rdd.getNumPartitions() >= files else pages.repartition(files)
    pages.select("title", "id", *inner).write.format("xml").option("rowTag", "page").option("rootTag", "collection").save(path)
    return path


DUMP_SQL = r"""WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id END AS title, text FROM documents WHERE text IS NOT NULL)"""


CLEAN_DUMP_SQL = r"""WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id END AS title, regexp_replace(text, '(?s)\{[^}]*\}.?', '', 'g') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT id, title, trim(array_to_string([w FOR w IN [translate(regexp_replace(split_part(x, '&', 1), '[^A-Za-z0-9''",.|]', '', 'g'), '|', ' ') FOR x IN string_split(text, ' ')] IF w <> '' AND length(w) < 20], ' ')) AS text FROM s)"""


@query(CLEAN_DUMP_SQL + " SELECT id, title, text FROM p WHERE text <> ''")
def xml_pages(spark, d):
    """Pages read back from an XML dump of the texts as they are, markup and all, and cleaned; the first id of a page counts."""
    return writers.clean_pages(readers.read_pages(spark, _dump(spark, d))).withColumn("text", F.trim("text")).where("text <> ''")


@query(DUMP_SQL + " SELECT id, title FROM p WHERE title IS NOT NULL")
def xml_valid_pages(spark, d):
    return readers.valid_pages(readers.read_pages(spark, _dump(spark, d))).select("id", "title")


@query(DUMP_SQL + r""", s AS (SELECT id, title, regexp_replace(text, '(?s)\{[^}]*\}.?', '', 'g') AS text FROM p),
c AS (SELECT id, title, array_to_string([w FOR w IN [translate(regexp_replace(split_part(x, '&', 1), '[^A-Za-z0-9''",.|]', '', 'g'), '|', ' ') FOR x IN string_split(text, ' ')] IF w <> '' AND length(w) < 20], ' ') AS text FROM s),
l AS (SELECT unnest(['<page>', '<id>' || id || '</id>', '<title>' || coalesce(title, '') || '</title>', '<text>' || text || '</text>', '</page>']) AS line FROM c) SELECT line, count(*) AS n FROM l GROUP BY line""")
def xml_cleaner(spark, d):
    """The lines of the XML cleaner's output file, and how often each comes; the cleaner reads the texts as they are, markup and all."""
    path = fresh_path(spark, "cleaned")
    cleaner.clean_dump(spark, _dump(spark, d), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _xml(column) -> Column:
    for c, entity in {"&": "&amp;", "<": "&lt;", ">": "&gt;"}.items():
        column = F.replace(column, F.lit(c), F.lit(entity))
    return column


def _broken_dump(spark, d) -> str:
    """The documents as a dump in which seven pages of ten are broken, each in one way, by the last digit of the number: 1 a stray end tag, 2 a tag without
    end, 3 a bare &, 4 a bad id, 5 no end of the page, 6 no text, 7 no id."""
    kind, i = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    text = F.concat(_xml(F.col("text")), F.when(kind == 1, F.lit("</ref>")).when(kind == 2, F.lit("<br>")).when(kind == 3, F.lit(" & ")).otherwise(F.lit("")))
    page = F.concat(
        F.lit("<page>\n <title>Page "), i, F.lit("</title>\n"), F.when(kind == 7, F.lit("")).otherwise(F.concat(F.lit(" <id>"), F.when(kind == 4, F.lit("x")).otherwise(F.lit("")), i, F.lit("</id>\n"))),
        F.when(kind == 6, F.lit("")).otherwise(F.concat(F.lit(' <text xml:space="preserve">'), text, F.lit("</text>\n"))), F.when(kind == 5, F.lit("")).otherwise(F.lit("</page>")),
    )
    path = fresh_path(spark, "dump")
    _docs(spark, d).where("text is not null").select(page).write.text(path)
    return path


@query("""SELECT CASE WHEN doc_id % 10 NOT IN (4, 7) THEN doc_id END AS id, 'Page ' || doc_id AS title,
CASE doc_id % 10 WHEN 1 THEN text || '</ref>' WHEN 2 THEN text || '<br>' WHEN 3 THEN text || ' & ' WHEN 6 THEN NULL ELSE text END AS text,
CASE doc_id % 10 WHEN 1 THEN 'markup' WHEN 2 THEN 'markup' WHEN 3 THEN 'markup' WHEN 5 THEN 'markup' WHEN 4 THEN 'bad id' WHEN 6 THEN 'no text' WHEN 7 THEN 'no id' END AS problem FROM documents WHERE text IS NOT NULL""")
def xml_quarantine(spark, d):
    """Every page of a dump with broken ones: good pages, what was recovered of the others, and what is wrong with them."""
    return readers.parse_pages(readers.page_chunks(spark, _broken_dump(spark, d))).select("id", "title", "text", "problem")


@query("SELECT page_id AS id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def tag_bodies(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), T.tag_body("html", "title").alias("title"))


# ---- index
@query(f"WITH {TOK} SELECT term, doc_id, array_to_string(positions, ',') AS positions, tf FROM postings")
def postings(spark, d):
    return _index(spark, d).postings.select("term", "doc_id", _text("positions"), "tf")


@query(f"WITH {TOK} SELECT term, doc_id, tf FROM postings")
def term_frequency(spark, d):
    return T.tokens(_docs(spark, d)).where(F.length("term") < T.MAX_TERM).groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))


@query(f"WITH {TOK} SELECT doc_id, n_tokens FROM sizes")
def doc_len_tokens(spark, d):
    return _index(spark, d).sizes.select("doc_id", "n_tokens")


@query(f"WITH {TOK} SELECT doc_id, n_terms FROM sizes")
def doc_len_terms(spark, d):
    return _index(spark, d).sizes.select("doc_id", "n_terms")


@query(f"WITH {TOK} SELECT doc_id, sum(tf)::BIGINT AS sum_tf, sum(tf * tf)::BIGINT AS norm2 FROM postings GROUP BY doc_id")
def doc_accumulator(spark, d):
    tf = T.tokens(_docs(spark, d)).where(F.length("term") < T.MAX_TERM).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("sum_tf"), F.sum(F.col("tf") * F.col("tf")).alias("norm2"))


@query("SELECT count(*) AS n_docs FROM documents")
def corpus_size(spark, d):
    return _docs(spark, d).agg(F.count("*").alias("n_docs"))


@query(f"WITH {TOK} SELECT term, df FROM df")
def document_frequency(spark, d):
    return index.document_frequency(_index(spark, d).postings)


@query(f"WITH {TOK} SELECT term, round(ln(n.n / df), 6) AS idf FROM df, n")
def idf(spark, d):
    i = _index(spark, d)
    return index.inverse_document_frequency(i.postings, i.n_docs).select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {TOK} SELECT term, doc_id, tf, size, df, round(tfidf, 6) AS tfidf FROM weights")
def tfidf(spark, d):
    return _index(spark, d).weights().select("term", "doc_id", "tf", "size", "df", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {TOK} SELECT DISTINCT term FROM postings")
def vocabulary(spark, d):
    return _index(spark, d).vocabulary()


@query(f"WITH {TOK}, l AS (SELECT term, doc_id, doc_id || ':' || tf || '/' || size || '/' || df || ':' || array_to_string(positions, ',') || ';' AS p FROM weights) SELECT term, term || '|' || string_agg(p, '' ORDER BY doc_id) AS line FROM l GROUP BY term")
def index_lines(spark, d):
    """A line for each term, with all its postings."""
    return writers.whole_lines(_index(spark, d).weights())


@query(_SQL["tfidf"])
def index_lines_roundtrip(spark, d):
    """The index as lines in files, read back, and weighted again."""
    path, i = fresh_path(spark, "lines"), _index(spark, d)
    writers.write_lines(writers.index_lines(i.weights(), 300), path, "gzip")
    return readers.index_of_lines(spark, path, i.n_docs).weights().select("term", "doc_id", "tf", "size", "df", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {TOK}, v AS (SELECT DISTINCT term FROM postings), e AS (SELECT substr(term, 1, g) AS prefix, g = length(term) AS ends FROM v, LATERAL (SELECT unnest(range(1, length(term) + 1)) AS g)) SELECT prefix, count(*) AS load, count(*) FILTER (ends) AS finished FROM e GROUP BY prefix")
def trie_counts(spark, d):
    return index.prefix_counts(_index(spark, d).vocabulary())


@query(f"WITH {TOK} SELECT term, doc_id, array_to_string(positions, ',') AS positions, tf FROM postings")
def index_upsert(spark, d):
    docs = _docs(spark, d)
    old, new = (index.doc_postings(docs.where(w)) for w in ("doc_id % 3 < 2", "doc_id % 3 >= 1"))
    return index.upsert(old, new).select("term", "doc_id", _text("positions"), "tf")


@query(f"WITH {TOK}, a AS (SELECT DISTINCT term FROM postings WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT term FROM postings WHERE doc_id % 2 = 1) SELECT coalesce(a.term, b.term) AS term, a.term IS NOT NULL AS in_old, b.term IS NOT NULL AS in_new FROM a FULL JOIN b ON a.term = b.term")
def index_merge_join(spark, d):
    """The vocabularies of two indexes, joined."""
    old, new = (index.build(_docs(spark, d).where(f"doc_id % 2 = {k}")).vocabulary().withColumn(f"in_{name}", F.lit(True)) for k, name in ((0, "old"), (1, "new")))
    return old.join(new, "term", "full").select("term", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_old", "in_new")])


# ---- search
@query(f"WITH {TOK} SELECT doc_id, array_to_string(positions, ',') AS positions FROM postings WHERE term = 'that'")
def posting_lookup(spark, d):
    return S.lookup(_index(spark, d), "that", positions=True).select("doc_id", _text("positions"))


def _ranked(score_sql: str, limit: str = "") -> str:
    return f"WITH {TOK}, s AS ({score_sql}) SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s {limit}"


def _score(words: dict[str, float], docs: str) -> str:
    share = "CASE term " + " ".join(f"WHEN '{w}' THEN {v!r}" for w, v in words.items()) + " END"
    return f"SELECT doc_id, sum({share} * tfidf) AS score FROM weights WHERE term IN ({', '.join(map(repr, words))}) AND doc_id IN ({docs}) GROUP BY doc_id"


def _has(w: str) -> str:
    return f"SELECT doc_id FROM postings WHERE term = '{w}'"


def _one(spark, d, text: str, k: int | None = None) -> DataFrame:
    return S.search(_index(spark, d), [(1, text)], k=k).select("doc_id", "score", "rank")


def _stored(spark, d) -> index.Index:
    path = fresh_path(spark, "index")
    _index(spark, d).write(path)
    return index.Index.read(spark, path)


@query(_ranked(_score({"that": 1.0}, _has("that"))))
def one_word(spark, d):
    return _one(spark, d, "that")


@query(_ranked(_score({"that": 0.5, "with": 0.25, "was": 0.25}, " UNION ".join(map(_has, ("that", "with", "was"))))))
def free_text(spark, d):
    return _one(spark, d, "that with was that")


@query(_ranked(_score({"that": 0.5, "with": 0.5}, f"{_has('that')} INTERSECT {_has('with')}")))
def bool_and(spark, d):
    return _one(spark, d, "that AND with")


@query(_ranked(_score({"that": 0.5, "keit": 0.5}, f"{_has('that')} UNION {_has('keit')}")))
def bool_or(spark, d):
    return _one(spark, d, "that OR keit")


@query(_ranked(_score({"that": 0.25, "was": 0.25, "keit": 0.25, "nicht": 0.25}, f"({_has('that')} INTERSECT {_has('was')}) UNION ({_has('keit')} INTERSECT {_has('nicht')})")))
def bool_nested(spark, d):
    return _one(spark, d, "(that AND was) OR (keit AND nicht)")


PHRASE_DOCS = "SELECT a.doc_id FROM (SELECT doc_id, unnest(positions) AS p FROM postings WHERE term = 'that') a JOIN (SELECT doc_id, unnest(positions) AS q FROM postings WHERE term = 'this') b ON a.doc_id = b.doc_id AND abs(q - p - 6) <= 5"


@query(_ranked(_score({"that": 0.5, "this": 0.5}, PHRASE_DOCS)))
def phrase(spark, d):
    return _one(spark, d, '"that this"')


def _sum_like(rx: str) -> str:
    return f"SELECT doc_id, sum(tfidf) AS score FROM weights WHERE regexp_matches(term, '{rx}') GROUP BY doc_id"


def _near_like(a: str, b: str) -> str:
    return f"SELECT a.doc_id, max(a.tfidf) AS score FROM (SELECT *, unnest(positions) AS p FROM weights WHERE regexp_matches(term, '{a}')) a JOIN (SELECT *, unnest(positions) AS q FROM weights WHERE regexp_matches(term, '{b}')) b ON a.doc_id = b.doc_id AND abs(b.q - a.p - length(b.term) - 2) <= 5 GROUP BY a.doc_id"


@query(_ranked(_sum_like("^heit.*$")))
def wildcard_prefix(spark, d):
    return _one(spark, d, "heit*")


@query(_ranked(_sum_like("^[^c]*chkeit$")))
def wildcard_suffix(spark, d):
    """On the stored grams of the vocabulary."""
    return S.search(_stored(spark, d), [(1, "*chkeit")]).select("doc_id", "score", "rank")


@query(_ranked(_sum_like("^th[^i]*in[^g]*g$")))
def wildcard_infix(spark, d):
    """On the stored grams of the vocabulary."""
    return S.search(_stored(spark, d), [(1, "th*in*g")]).select("doc_id", "score", "rank")


@query(_ranked(_near_like("^heit.*$", "^[^n]*nd$")))
def wildcard_phrase(spark, d):
    return _one(spark, d, '"heit* *nd"')


@query(_ranked(_score({"that": 0.5, "with": 0.5}, f"{_has('that')} UNION {_has('with')}"), "QUALIFY rank <= 10"))
def topk_per_query(spark, d):
    return _one(spark, d, "that with", k=10)


#: The SQL of each query of BATCH: its kind, and its documents with their scores.
BATCH_SQL = {
    1: ("one_word", _score({"that": 1.0}, _has("that"))),
    2: ("one_word", _score({"thth": 1.0}, _has("thth"))),
    3: ("free_text", _score({"that": 0.5, "with": 0.5}, f"{_has('that')} UNION {_has('with')}")),
    4: ("boolean", _score({"that": 0.5, "with": 0.5}, f"{_has('that')} INTERSECT {_has('with')}")),
    5: ("phrase", _score({"that": 0.5, "this": 0.5}, PHRASE_DOCS)),
    6: ("boolean", _score({"that": 1 / 3, "was": 1 / 3, "keit": 1 / 3}, f"({_has('that')} INTERSECT {_has('was')}) UNION {_has('keit')}")),
    7: ("boolean", _score({"with": 0.25, "this": 0.25, "are": 0.25, "was": 0.25}, f"{_has('with')} UNION ({_has('this')} INTERSECT {_has('are')} INTERSECT {_has('was')})")),
    8: ("wildcard", _sum_like("^heit.*$")),
    9: ("wildcard", _sum_like("^[^c]*chkeit$")),
    10: ("wildcard_phrase", _near_like("^th.*$", "^[^n]*nd$")),
    11: ("free_text", _score({"that": 2 / 3, "with": 1 / 3}, f"{_has('that')} UNION {_has('with')}")),
    12: ("one_word", _score({"zzzzz": 1.0}, _has("zzzzz"))),
}


def _batch_sql() -> str:
    parts = [f"SELECT {i} AS qid, '{text}' AS query, '{BATCH_SQL[i][0]}' AS qtype, doc_id, round(score, 6) AS score FROM ({BATCH_SQL[i][1]})" for i, text in BATCH]
    return f"WITH {TOK}, s AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s)"


@query(_batch_sql() + " SELECT qid, query, qtype, rank, doc_id, score FROM r")
def ranked_batch(spark, d):
    return S.search(_index(spark, d), BATCH)


@query(_batch_sql() + " SELECT qid, query || ' => ' || string_agg(doc_id, ', ' ORDER BY rank) AS line FROM r GROUP BY qid, query")
def result_lines(spark, d):
    return writers.result_lines(S.search(_index(spark, d), BATCH))


@query(f"WITH {TOK}, s AS ({_score({'that': 1.0}, _has('that'))}), t AS (SELECT page_id AS id, trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) AS title FROM pages) SELECT doc_id, round(score, 6) AS score, title FROM s LEFT JOIN t ON t.id = s.doc_id")
def titled_results(spark, d):
    titles = readers.html_pages(spark.read.parquet(f"{d}/pages.parquet")).select("id", "title")
    return S.search(_index(spark, d), [(1, "that")], titles=titles).select("doc_id", "score", "title")


@query(_SQL["topk_per_query"])
def topk_pruned(spark, d):
    """The best ten over the stored index, whose blocks below the threshold are not read."""
    return S.search(_stored(spark, d), [(1, "that with")], k=10).select("doc_id", "score", "rank")


@query(_SQL["ranked_batch"])
def stored_batch(spark, d):
    """The batch over the stored index: words that must stand together are read only in ranges where all of them are."""
    return S.search(_stored(spark, d), BATCH)


@query(_SQL["ranked_batch"])
def ranked_ranges(spark, d):
    """The batch, numbered by ranges of the score: no task sees all matches of a query."""
    return S.search(_index(spark, d), BATCH, by_ranges=True)


@query(f"WITH {TOK} SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS place FROM postings WHERE term = 'that'")
def term_documents(spark, d):
    """The documents of a term in order, with their places, from the stored index."""
    return numbering.numbered(S.lookup(_stored(spark, d), "that"), "doc_id", name="place")


@query(f"WITH {TOK}, m AS (SELECT doc_id, max(term) AS term FROM postings GROUP BY doc_id) SELECT term, doc_id, array_to_string(positions, ',') AS positions FROM postings JOIN m USING (term, doc_id)")
def posting_points(spark, d):
    """The postings of pairs of a term and a document: of each document its last term."""
    i = _stored(spark, d)
    pairs = i.postings.groupBy("doc_id").agg(F.max("term").alias("term"))
    asked = pairs.unionByName(pairs.withColumn("term", F.lit("no such term")))
    return blocks.point_lookup(i, asked).select("term", "doc_id", _text("positions"))


def _intersect_sql(op: str) -> str:
    return f"WITH {TOK} {_has('that')} {op} {_has('keit')}"


@query(_intersect_sql("INTERSECT"))
def set_and(spark, d):
    i = _index(spark, d)
    return S.lookup(i, "that").intersect(S.lookup(i, "keit"))


@query(_intersect_sql("UNION"))
def set_or(spark, d):
    i = _index(spark, d)
    return S.lookup(i, "that").union(S.lookup(i, "keit")).distinct()


# ---- stems
def _porter_sql() -> str:
    cut = lambda n: f"substr(w, 1, length(w) - {n})"
    like = lambda rx, x: f"regexp_matches({x}, '{rx}')"

    def rules(step) -> str:
        out = "CASE"
        for suffix, new, condition in step:
            rest = cut(len(suffix))
            ok = f"{like(T.M_GT_1, rest)} AND {like('[st]$', rest)}" if condition == "ION" else like(condition, rest) if condition else "true"
            out += f" WHEN suffix(w, '{suffix}') THEN CASE WHEN {ok} THEN {rest} || '{new}' ELSE w END"
        return out + " ELSE w END"

    steps = [f"SELECT term, regexp_replace(term, '^y', 'Y') AS w FROM v", f"SELECT term, {rules(T.STEP_1A)} AS w FROM s0"]
    bare = f"CASE WHEN suffix(w, 'eed') THEN NULL WHEN suffix(w, 'ed') AND {like(T.HAS_VOWEL, cut(2))} THEN {cut(2)} WHEN suffix(w, 'ing') AND {like(T.HAS_VOWEL, cut(3))} THEN {cut(3)} END"
    steps.append(f"SELECT term, {bare} AS bare, CASE WHEN suffix(w, 'eed') AND {like(T.M_GT_0, cut(3))} THEN {cut(1)} ELSE w END AS w FROM s1")
    mended = f"CASE WHEN {like('(at|bl|iz)$', 'bare')} THEN bare || 'e' WHEN {like(T.DOUBLE_END, 'bare')} THEN substr(bare, 1, length(bare) - 1) WHEN {like(T.SHORT_END, 'bare')} THEN bare || 'e' ELSE bare END"
    steps.append(f"SELECT term, CASE WHEN bare IS NOT NULL THEN {mended} ELSE w END AS w FROM s2")
    steps.append(f"SELECT term, CASE WHEN suffix(w, 'y') AND {like(T.HAS_VOWEL, cut(1))} THEN {cut(1)} || 'i' ELSE w END AS w FROM s3")
    for k, r in enumerate((T.STEP_2, T.STEP_3, T.STEP_4)):
        steps.append(f"SELECT term, {rules(r)} AS w FROM s{4 + k}")
    steps.append(f"SELECT term, CASE WHEN suffix(w, 'e') AND ({like(T.M_GT_1, cut(1))} OR ({like(T.M_EQ_1, cut(1))} AND NOT {like(T.SHORT_END, cut(1))})) THEN {cut(1)} ELSE w END AS w FROM s7")
    steps.append(f"SELECT term, CASE WHEN suffix(w, 'll') AND {like(T.M_GT_1, 'w')} THEN {cut(1)} ELSE w END AS w FROM s8")
    chain = ", ".join(f"s{i} AS ({s})" for i, s in enumerate(steps))
    return f"v AS (SELECT DISTINCT term FROM tokens), {chain}, stems AS (SELECT term, CASE WHEN length(term) < 3 THEN term ELSE lower(w) END AS stem FROM s9)"


@query(f"WITH {TOK}, {_porter_sql()} SELECT term, stem FROM stems")
def porter_stem(spark, d):
    return T.porter_stems(T.tokens(_docs(spark, d)).select("term").distinct())


@query(f"WITH {TOK}, {_porter_sql()} SELECT stem AS term, doc_id, array_to_string(list(pos ORDER BY pos), ',') AS positions, count(*)::INT AS tf FROM tokens JOIN stems USING (term) WHERE length(stem) < 25 GROUP BY stem, doc_id")
def stemmed_postings(spark, d):
    return index.build(_docs(spark, d), stem=True).postings.select("term", "doc_id", _text("positions"), "tf")


@query(rf"WITH {TITLED}, p AS (SELECT id, string_split({NORMAL}, ' ') AS ws FROM titled), e AS (SELECT id, unnest(ws) AS term, generate_subscripts(ws, 1) AS ord FROM p), tokens AS (SELECT DISTINCT term FROM e WHERE term <> ''), {_porter_sql()} SELECT id, coalesce(string_agg(stem, ' ' ORDER BY ord) FILTER (stem <> '' AND stem NOT IN ({IN_STOP})), '') AS text FROM e LEFT JOIN stems USING (term) GROUP BY id")
def normalize_page_stemmed(spark, d):
    """The whole page normaliser; normalize_page is the same without stems."""
    pages = _titled(spark, d)
    return T.normalise_pages(pages, STOP, T.porter_stems(T.page_words(pages)))


# ---- key-value rows
def _nations(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("payload"))


def _orders(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("key"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("payload"))


def _store(spark, d) -> kv_store.Store:
    return kv_store.Store.create(_orders(spark, d), fresh_path(spark, "store"), chunk_rows=2000)


ORDERS = "o AS (SELECT o_orderkey::BIGINT AS key, 'customer ' || o_custkey AS payload FROM orders)"


@query(f"WITH {ORDERS} SELECT key, payload FROM o WHERE key - 1 IN (SELECT key FROM o)")
def kv_search(spark, d):
    """The rows whose keys follow those of orders, looked up in the store; keys that are not there find nothing."""
    return _store(spark, d).search_keys(_orders(spark, d).select((F.col("key") + 1).alias("key")))


@query(f"WITH {ORDERS} SELECT key, payload FROM o WHERE payload IN (SELECT 'customer ' || c_custkey FROM customer WHERE c_nationkey = 7)")
def kv_search_value(spark, d):
    """The orders of the customers of one nation, by their payload."""
    asked = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey = 7").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("payload"))
    return _store(spark, d).search_values(asked.unionByName(asked.select(F.concat("payload", F.lit(" not")).alias("payload"))))


@query(f"WITH {ORDERS} SELECT key, CASE WHEN key % 3 = 1 THEN 'changed' ELSE payload END AS payload FROM o")
def kv_update(spark, d):
    """A batch of new payloads for a third of the keys, and for some that are not there."""
    changes = _orders(spark, d).where("key % 3 = 1").select("key", F.lit("changed").alias("payload"))
    return _store(spark, d).update(changes.unionByName(changes.select((-F.col("key") - 1).alias("key"), "payload"))).rows()


@query("SELECT n_nationkey::BIGINT AS key, n_name AS payload FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY h), h FROM (SELECT md5(coalesce(text, '')) AS h FROM documents)")
def kv_insert(spark, d):
    """A row for each document, numbered in order of its text's digest."""
    return kv.insert(_nations(spark, d), _docs(spark, d).select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("payload")))


@query(f"WITH {ORDERS}, n AS (SELECT (SELECT max(key) FROM o) + row_number() OVER (ORDER BY h) AS key, h AS payload FROM (SELECT md5(coalesce(text, '')) AS h FROM documents)) SELECT * FROM (SELECT * FROM o UNION ALL SELECT * FROM n) ORDER BY key")
def kv_ordered(spark, d):
    """The store in order of its keys, after a row for each document has been added to it."""
    return _store(spark, d).insert(_docs(spark, d).select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("payload"))).ordered()


@query(f"WITH {TOK} SELECT term, doc_id, tf FROM postings")
def incremental_index(spark, d):
    """The index after three batches of pages have been merged into the folder one by one."""
    path = fresh_path(spark, "index")
    docs = _docs(spark, d)
    for k in range(3):
        incremental.merge_batch(spark, docs.where(F.col("doc_id") % 3 == k), path, write=False)
    return segments.read(spark, path).select("term", "doc_id", "tf")


@query(f"WITH {TOK} SELECT term, doc_id, array_to_string(positions, ',') AS positions, tf FROM postings")
def index_rewrite(spark, d):
    """An index that is replaced by itself and the pages it lacks."""
    path, docs = fresh_path(spark, "index"), _docs(spark, d)
    rows, layout = index.laid_out(docs.where("doc_id % 2 = 0"))
    segments.rewrite(rows, path, layout)
    old = segments.rows(spark, path)
    rows, layout = index.laid_out(segments.lacking(docs.where("doc_id % 2 = 1"), old.where("term is null")), old=old)
    segments.rewrite(rows, path, layout)
    return segments.read(spark, path).select("term", "doc_id", _text("positions"), "tf")


@query(_SQL["ranked_batch"])
def segmented_ranked_batch(spark, d):
    """The batch over an index that four batches of pages have built in segments, of which some were merged."""
    path, docs = fresh_path(spark, "index"), _docs(spark, d)
    for k in range(4):
        incremental.merge_batch(spark, docs.where(F.col("doc_id") % 4 == k), path, limit=3, write=False)
    return S.search(segments.open_index(spark, path), BATCH)


def _asked(column: str, kind: str) -> str:
    return f"SELECT doc_id AS qid, {column} AS query, '{kind}' AS qtype, a, b FROM ab WHERE doc_id % 5 = "


@query(f"""WITH {TOK}, ab AS (SELECT doc_id, max(term) AS a, min(term) AS b FROM postings WHERE length(term) > 3 AND regexp_full_match(term, '[a-z]+') GROUP BY doc_id HAVING count(*) > 1),
q AS ({_asked('a', 'one_word')} 0 UNION ALL {_asked("a || ' ' || b", 'free_text')} 1 UNION ALL {_asked("a || ' AND ' || b", 'boolean')} 2 UNION ALL {_asked("a || ' OR (' || b || ' AND ' || a || ')'", 'boolean')} 3 UNION ALL {_asked("'*' || substr(a, 2)", 'wildcard')} 4),
s AS (SELECT qid, doc_id, sum(CASE WHEN qtype = 'one_word' THEN 1.0 WHEN qid % 5 = 3 AND term = a THEN 2.0 / 3 WHEN qid % 5 = 3 THEN 1.0 / 3 ELSE 0.5 END * tfidf) AS score, count(DISTINCT term) AS n, bool_or(term = a) AS has_a
FROM (SELECT qid, qtype, a, a AS term FROM q WHERE qtype <> 'wildcard' UNION ALL SELECT qid, qtype, a, b FROM q WHERE qtype NOT IN ('one_word', 'wildcard')) JOIN weights USING (term) GROUP BY qid, doc_id),
e AS (SELECT qid, term FROM q JOIN df ON suffix(term, substr(a, 2)) AND NOT contains(left(term, length(term) - length(a) + 1), substr(a, 2, 1)) WHERE qtype = 'wildcard'),
f AS (SELECT qid, doc_id, score FROM s WHERE CASE qid % 5 WHEN 2 THEN n = 2 WHEN 3 THEN has_a ELSE true END
UNION ALL SELECT qid, doc_id, sum(tfidf) FROM e JOIN weights USING (term) GROUP BY qid, doc_id),
r AS (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 10)
SELECT qid, query, qtype, rank, doc_id, score FROM r JOIN q USING (qid)""")
def query_table(spark, d):
    """The best ten documents for a query of each document: one of five kinds, made of two of its words."""
    i = _index(spark, d)
    word = i.postings.where("length(term) > 3 and term rlike '^[a-z]+$'").groupBy("doc_id").agg(F.max("term").alias("a"), F.min("term").alias("b"), F.count("*").alias("n")).where("n > 1")
    kinds = ["a", "concat(a, ' ', b)", "concat(a, ' AND ', b)", "concat(a, ' OR (', b, ' AND ', a, ')')", "concat('*', substr(a, 2))"]
    text = F.expr("case pmod(doc_id, 5) " + " ".join(f"when {k} then {e}" for k, e in enumerate(kinds)) + " end")
    path = fresh_path(spark, "index")
    i.write(path)
    return table.search_table(index.Index.read(spark, path), word.select(F.col("doc_id").alias("qid"), text.alias("query")), k=10)


@query(f"WITH {TOK} SELECT (SELECT n FROM n) AS n_docs, (SELECT count(*) FROM df) AS n_words, (SELECT sum(df) FROM df)::BIGINT AS n_postings, (SELECT sum(n_tokens) FROM sizes)::BIGINT AS n_tokens")
def prior_index(spark, d):
    """What an index in segments says of itself, without a look at its postings: pages, words, postings, tokens."""
    path, docs = fresh_path(spark, "index"), _docs(spark, d)
    for k in range(2):
        incremental.merge_batch(spark, docs.where(F.col("doc_id") % 2 == k), path, write=False)
    i = segments.open_index(spark, path)
    none = F.lit(0).cast("long")
    words = i.terms.select(F.lit(1).cast("long").alias("word"), F.col("df").alias("postings"), none.alias("tokens"))
    sizes = i.sizes.select(none.alias("word"), none.alias("postings"), F.col("n_tokens").cast("long").alias("tokens"))
    sums = words.unionByName(sizes).agg(F.sum("word").alias("n_words"), F.sum("postings").alias("n_postings"), F.sum("tokens").alias("n_tokens"))
    return sums.select(F.lit(i.n_docs).cast("long").alias("n_docs"), "n_words", "n_postings", "n_tokens")


FINAL = "final AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN text || ' renewed page' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 5)"


@query(f"WITH {FINAL}, {_tok(table='final')} SELECT term, doc_id, array_to_string(positions, ',') AS positions, tf, size, df, round(tfidf, 6) AS tfidf FROM weights")
def index_replace_pages(spark, d):
    """An index in which a third of the pages came again with other texts and a seventh was deleted, some of both before and some after a merge."""
    path, docs = fresh_path(spark, "index"), _docs(spark, d)
    final = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" renewed page"))).otherwise(F.col("text")))
    half = F.col("doc_id") % 2 == 0
    incremental.merge_batch(spark, docs.where(half).withColumn("text", F.concat(F.lit("first words "), "text")), path, limit=2, write=False)
    incremental.merge_batch(spark, docs.where("doc_id % 7 = 5 or doc_id % 2 = 1"), path, limit=2, write=False)
    incremental.merge_batch(spark, final.where(half & (F.col("doc_id") % 3 != 1)), path, limit=2, deletes=docs.where("doc_id % 14 = 5").select("doc_id"), write=False)
    incremental.merge_batch(spark, final.where("doc_id % 3 = 1 and doc_id % 7 <> 5"), path, limit=4, deletes=docs.where("doc_id % 7 = 5").select("doc_id"), write=False)
    rows = segments.open_index(spark, path).weights()
    return rows.select("term", "doc_id", _text("positions"), "tf", "size", "df", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {TOK} SELECT term, p.doc_id, array_to_string(positions, ',') AS positions, tf, CASE WHEN p.doc_id % 5 <> 0 THEN 'Page ' || p.doc_id END AS title FROM postings p")
def dump_stream(spark, d):
    """A dump in three files, streamed into an index with its titles, a file at a time."""
    base = fresh_path(spark, "stream")
    pages = readers.stream_pages(spark, _dump(spark, d, files=3), files=1)
    incremental.index_stream(pages, f"{base}/index", f"{base}/checkpoint", limit=2).awaitTermination()
    i = segments.open_index(spark, f"{base}/index")
    titles = i.sizes.where("title is not null").select("doc_id", "title")
    return i.postings.join(small_side(titles, TITLES), "doc_id", "left").select("term", "doc_id", _text("positions"), "tf", "title")


ASKED = ["the that", "things AND was", '"that this"', "is"]


@query(f"""WITH {_tok(stop=True)}, {_porter_sql()},
st AS (SELECT stem, doc_id, list(pos) AS positions, count(*) AS tf FROM tokens JOIN stems USING (term) GROUP BY stem, doc_id),
sw AS (SELECT stem, doc_id, positions, tf / n_tokens * ln((SELECT n FROM n) / count(*) OVER (PARTITION BY stem)) AS w FROM st JOIN sizes USING (doc_id) WHERE length(stem) < 25),
a AS (SELECT 1 AS qid, doc_id, w AS score FROM sw WHERE stem = 'that'
UNION ALL SELECT 2, x.doc_id, (x.w + y.w) / 2 FROM sw x JOIN sw y USING (doc_id) WHERE x.stem = 'thing' AND y.stem = 'wa'
UNION ALL SELECT 3, x.doc_id, (x.w + y.w) / 2 FROM sw x JOIN sw y USING (doc_id) WHERE x.stem = 'that' AND y.stem = 'thi' AND EXISTS (SELECT 1 FROM (SELECT unnest(x.positions) AS p), (SELECT unnest(y.positions) AS q) WHERE abs(q - p - 5) <= 5)),
r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM a)
SELECT qid::INT AS qid, CASE qid {' '.join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(ASKED, 1))} END || ' => ' || string_agg(doc_id, ', ' ORDER BY rank) AS line FROM r GROUP BY qid""")
def query_files(spark, d):
    """End to end: an index with stems is written and read, queries and stopwords come from files, and result lines come out."""
    base = fresh_path(spark, "files")
    for name, lines in (("stop", STOP), ("asked", ASKED)):
        # one file, whose lines keep their order
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{base}/{name}")
    stop = [r.word for r in readers.read_stopwords(spark, f"{base}/stop").collect()]
    index.build(_docs(spark, d), stop, stem=True).write(f"{base}/index")
    asked = [(r.qid, r.query) for r in readers.read_queries(spark, f"{base}/asked").collect()]
    return writers.result_lines(S.search(index.Index.read(spark, f"{base}/index"), asked, stop)).select("qid", "line")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
