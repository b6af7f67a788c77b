"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from importlib import import_module

from ._stage import ship

_OPERATORS = {
    "op1_substring_dedup": "substring_dedup",
    "op2_lm_scoring": "lm_scoring",
    "op3_benchmark_decontamination": "decontamination",
    "op4_ngram_jaccard_join": "ngram_join",
    "op5_language_id": "language_id",
    "op6_bpe_codec": "bpe",
    "op7_quality_classifier": "importance_resampling",
    "op8_toxicity": "toxicity",
    "op9_sharding": "sharding",
    "op10_quality_rules": "quality_rules",
    "op11_source_audit": "source_audit",
    "op12_ranked_search": "ranked_search",
    "op13_token_records": "token_records",
}


def _query(module: str, name: str):
    run = getattr(import_module(f"{__package__}.{module}"), name)

    def query(spark, sf_dir):
        ship(spark)
        return run(spark, sf_dir)

    query.__name__, query.__doc__ = name, run.__doc__
    return query


def queries() -> dict:
    return {name: _query(module, name) for name, module in _OPERATORS.items()}


_SPACE = r"[ \t\n\x0b\x0c\r]"
_WORDS = "[x FOR x IN regexp_split_to_array({0}, '" + _SPACE + "+') IF x <> '']"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1_sql() -> str:
    return f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i AS s, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) t(i)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM rep, unnest(range(0, 20)) t(j)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT e.doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL), '') AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def _op4_sql() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"coalesce({_LOWER}, '')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) t(i) UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(d, o) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.o)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(o, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(o) AS o FROM r GROUP BY d) ON d = doc_id"""


def _op10_sql() -> str:
    from . import quality_rules as q

    tests = (len(q.BANDS) + 1) * len(q.RULES) * len(q.GRID)
    band = " + ".join(f"(n_words >= {b})::INT" for b in q.BANDS)
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} * 10000 / {b}::DOUBLE ELSE 0 END"
    parts = dict(zip(q.RULES, (("n_symbols", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines")), strict=True))
    long = " UNION ALL ".join(f"SELECT band, quality, '{r}' AS rule, {r} AS ratio FROM known" for r in q.RULES)
    limits = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS max_{r}" for r in q.RULES)
    passed = " AND ".join(f"coalesce({r} <= max_{r}, true)" for r in q.RULES)
    p = q.ALPHA / len(q.RULES)
    tail = f"list_sum([exp(lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + i * ln({p}) + (n1 - i) * ln({1 - p})) FOR i IN range(0, good + 1)])"
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^ \\t\\n\x0b\x0c\\r]')] AS ls FROM documents),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, unnest([0, 1, 2]) u(j) GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN cov USING (rid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {band} AS band, {', '.join(f'{share(a, b)} AS {r}' for r, (a, b) in parts.items())} FROM f),
known AS (SELECT base.*, quality FROM base JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
cells AS (SELECT band, rule, g AS cutoff, count(*) FILTER (quality = 1 AND ratio > g) AS good, count(*) FILTER (quality = 0 AND ratio > g) AS bad, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM ({long}), unnest([{', '.join(map(str, q.GRID))}]) u(g) GROUP BY ALL),
gains AS (SELECT *, bad / greatest(n0, 1) - good / greatest(n1, 1) AS gain FROM cells),
best AS (SELECT band, rule, cutoff FROM gains WHERE good < {p} * n1 AND gain > 0 AND {tail} <= {q.DELTA / tests!r} QUALIFY row_number() OVER (PARTITION BY band, rule ORDER BY gain DESC, cutoff DESC) = 1),
lim AS (SELECT band AS of_band, {limits} FROM best GROUP BY band)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept FROM base LEFT JOIN lim ON band = of_band"""


def _op11_sql() -> str:
    share = lambda n, total: f"1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v)"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT c.* FROM c JOIN f USING (lang, term)),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(DISTINCT term) AS v, sum(n) AS ln FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(t.n, 0) AS total, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln FROM g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM k GROUP BY ALL) t USING (lang, source) LEFT JOIN l USING (lang)),
dense AS (SELECT gn.lang, gn.source, f.term, coalesce(k.n, 0) AS n, {share("coalesce(k.n, 0)", "total")} AS p FROM gn JOIN f USING (lang) LEFT JOIN k ON k.lang = gn.lang AND k.source = gn.source AND k.term = f.term),
lq AS (SELECT lang, term, {share("sum(n)", "any_value(ln)")} AS q FROM k JOIN l USING (lang) GROUP BY lang, term, v),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
above AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM dense JOIN lq USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM above)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""


def _op12_sql() -> str:
    terms = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {terms} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS nn, sum(len(ts))::BIGINT AS ll FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": _op1_sql(), "op4_ngram_jaccard_join": _op4_sql(), "op10_quality_rules": _op10_sql(),
        "op11_source_audit": _op11_sql(), "op12_ranked_search": _op12_sql(),
    }
