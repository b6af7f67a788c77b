"""Text functions as Columns: cleaning, tokens, positions, anagram keys and the Porter stemmer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELIMITERS = "[ \\n\\t<]"
MAX_TERM = 25
CLEAN_MAX = 20


def anagram_key(word) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def strip_punctuation(text) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9\\s]", ""), "\\s+", " ")


def strip_templates(text) -> Column:
    """{{...}} up to the first closing brace and one character beyond it."""
    return F.regexp_replace(text, "(?s)\\{[^}]*\\}.?", "")


def clean_words(text) -> Column:
    """Words cut at the first &, of letters, digits and '",.| only, | as a space, shorter than CLEAN_MAX."""
    words = F.transform(F.split(text, " "), lambda w: F.translate(F.regexp_replace(F.substring_index(w, "&", 1), "[^A-Za-z0-9'\",.|]", ""), "|", " "))
    return F.array_join(F.filter(words, lambda w: (w != "") & (F.length(w) < CLEAN_MAX)), " ")


def is_good_tag(tag) -> Column:
    return F.col(tag).rlike("^(id|title|text|page)") if isinstance(tag, str) else tag.rlike("^(id|title|text|page)")


def tag_body(text, tag: str) -> Column:
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def tokens(docs: DataFrame, stopwords: list[str] | None = None, partitions: int | None = None, dealt: bool = False) -> DataFrame:
    """doc_id, ord, pos, raw, term of each token that keeps a letter or digit; terms may be as long as they come.

    pos is the offset of the delimiter behind the token in the lower-cased text without its stopwords. Texts are
    dealt out by doc_id before they are split, so the running sum needs no shuffle of tokens; dealt: they are already.
    """
    rows = docs.select("doc_id", "text").where("text is not null")
    if not dealt:
        rows = rows.repartition(partitions, "doc_id") if partitions else rows.repartition("doc_id")
    raw = rows.select("doc_id", F.posexplode(F.split("text", DELIMITERS)).alias("ord", "raw"))
    if stopwords:
        raw = raw.where(~F.col("raw").isin(stopwords))
    run = Window.partitionBy("doc_id").orderBy("ord")
    raw = raw.withColumn("pos", (F.sum(F.length("raw") + 1).over(run) - 1).cast("int"))
    return raw.withColumn("term", F.regexp_replace(F.lower("raw"), "[^a-z0-9]", "")).where("term <> ''")


def normalise_pages(pages: DataFrame, stopwords: list[str], stems: DataFrame | None = None) -> DataFrame:
    """id and text: title and text joined, punctuation dropped, lower-cased, stemmed where stems are given, without stopwords."""
    words = F.split(F.lower(strip_punctuation(F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))), " ")
    if stems is None:
        stop = F.array(*[F.lit(s) for s in stopwords]) if stopwords else F.array().cast("array<string>")
        return pages.select("id", F.array_join(F.filter(words, lambda w: ~F.array_contains(stop, w) & (w != "")), " ").alias("text"))
    # Each row is a page of its own, also where ids repeat, and stays where no word is left.
    split = pages.select("id", F.monotonically_increasing_id().alias("row"), words.alias("words")).select("id", "row", F.posexplode("words").alias("ord", "term")).join(stems, "term", "left")
    split = split.select("id", "row", "ord", F.coalesce("stem", "term").alias("w"))
    kept = F.when((F.col("w") != "") & ~F.col("w").isin(stopwords), F.struct("ord", "w"))
    ordered = F.array_sort(F.collect_list(kept))
    return split.groupBy("id", "row").agg(F.array_join(F.transform(ordered, lambda x: x["w"]), " ").alias("text")).drop("row")


def page_words(pages: DataFrame) -> DataFrame:
    """Distinct words (term) of the pages as normalise_pages splits them."""
    words = F.split(F.lower(strip_punctuation(F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))), " ")
    return pages.select(F.explode(words).alias("term")).where("term <> ''").distinct()


# Porter (1980). Suffixes, replacements and measures of the published algorithm.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_GT_0 = f"^({_C})?{_V}{_C}"
M_EQ_1 = f"^({_C})?{_V}{_C}({_V})?$"
M_GT_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^({_C})?[aeiouy]"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE_END = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxy") + ")$"
#: (suffix, replacement, condition on what stands before it); the first suffix that fits decides.
STEP_1A = [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")]
STEP_2 = [(a, b, M_GT_0) for a, b in (("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"))]
STEP_3 = [(a, b, M_GT_0) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))]
STEP_4 = [(a, "", M_GT_1) for a in ("ement", "ance", "ence", "able", "ible", "ment")] + [("ion", "", "ION"), ("ant", "", M_GT_1), ("ent", "", M_GT_1)] + [(a, "", M_GT_1) for a in ("ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")]


def _suffixes(w: Column, rules) -> Column:
    out = None
    for suffix, new, condition in rules:
        rest = F.expr(f"substr(w, 1, length(w) - {len(suffix)})")
        fits = w.endswith(suffix)
        ok = rest.rlike(M_GT_1) & rest.rlike("[st]$") if condition == "ION" else rest.rlike(condition) if condition else F.lit(True)
        value = F.when(ok, F.concat(rest, F.lit(new))).otherwise(w)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(w)


def _cut(n: int) -> Column:
    return F.expr(f"substr(w, 1, length(w) - {n})")


def porter_stems(words: DataFrame, column: str = "term") -> DataFrame:
    """term, stem for the rows of words, which should be distinct: a chain of Column expressions, one projection for each step."""
    d = words.select(column, F.regexp_replace(column, "^y", "Y").alias("w"))
    w = F.col("w")
    d = d.withColumn("w", _suffixes(w, STEP_1A))
    eed, ed, ing = (w.endswith(x) for x in ("eed", "ed", "ing"))
    d = d.withColumn("bare", F.when(eed, F.lit(None)).when(ed & _cut(2).rlike(HAS_VOWEL), _cut(2)).when(ing & _cut(3).rlike(HAS_VOWEL), _cut(3)))
    d = d.withColumn("w", F.when(eed & _cut(3).rlike(M_GT_0), _cut(1)).otherwise(w))
    bare = F.col("bare")
    mended = F.when(bare.rlike("(at|bl|iz)$"), F.concat("bare", F.lit("e"))).when(bare.rlike(DOUBLE_END), F.expr("substr(bare, 1, length(bare) - 1)")).when(bare.rlike(SHORT_END), F.concat("bare", F.lit("e"))).otherwise(bare)
    d = d.withColumn("w", F.when(bare.isNotNull(), mended).otherwise(w)).drop("bare")
    d = d.withColumn("w", F.when(w.endswith("y") & _cut(1).rlike(HAS_VOWEL), F.concat(_cut(1), F.lit("i"))).otherwise(w))
    for rules in (STEP_2, STEP_3, STEP_4):
        d = d.withColumn("w", _suffixes(w, rules))
    d = d.withColumn("w", F.when(w.endswith("e") & (_cut(1).rlike(M_GT_1) | (_cut(1).rlike(M_EQ_1) & ~_cut(1).rlike(SHORT_END))), _cut(1)).otherwise(w))
    d = d.withColumn("w", F.when(w.endswith("ll") & w.rlike(M_GT_1), _cut(1)).otherwise(w))
    d = d.select(column, F.when(F.length(column) < 3, F.col(column)).otherwise(F.lower("w")).alias("stem"))
    # A grouping by the key keeps conditions on the stem from being pushed into, and multiplied through, the chain.
    return d.groupBy(column).agg(F.max("stem").alias("stem"))


def porter_stem(word: str) -> str:
    """The same steps for one word of a query, on the driver."""
    import re

    if len(word) < 3:
        return word
    has = lambda rx, s: re.search(rx, s) is not None
    w = "Y" + word[1:] if word[0] == "y" else word

    def apply(w, rules):
        for suffix, new, condition in rules:
            if w.endswith(suffix):
                rest = w[: len(w) - len(suffix)]
                ok = has(M_GT_1, rest) and rest[-1:] in ("s", "t") if condition == "ION" else has(condition, rest)
                return rest + new if ok else w
        return w

    w = apply(w, STEP_1A)
    bare = None
    if w.endswith("eed"):
        w = w[:-1] if has(M_GT_0, w[:-3]) else w
    elif w.endswith("ed") and has(HAS_VOWEL, w[:-2]):
        bare = w[:-2]
    elif w.endswith("ing") and has(HAS_VOWEL, w[:-3]):
        bare = w[:-3]
    if bare is not None:
        w = bare + "e" if has("(at|bl|iz)$", bare) else bare[:-1] if has(DOUBLE_END, bare) else bare + "e" if has(SHORT_END, bare) else bare
    if w.endswith("y") and has(HAS_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3, STEP_4):
        w = apply(w, rules)
    if w.endswith("e") and (has(M_GT_1, w[:-1]) or has(M_EQ_1, w[:-1]) and not has(SHORT_END, w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and has(M_GT_1, w):
        w = w[:-1]
    return w.lower()
