"""Language of texts and of the spans in mixed-language texts.

Training counts hashed byte trigrams inside words, and the scripts of their letters, by language. A word
scores, for each language, the log probabilities of its trigrams; the script of its letters rules out
languages that hardly use that script. Viterbi over the words of a text, with a fixed penalty for a switch
of language, labels its spans; the language with most labelled bytes of words is that of the text, and its share
is the score.

Defined cases: `und` with score 0 for null text, for text without any letter, and where nothing was learned;
null doc_id is trained on and not held out; every input row gives one row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

BUCKETS, SWITCH, MIN_SHARE, RULED_OUT = 1 << 16, 12.0, 0.002, -60.0
U = np.uint64


#: The ranges of code points of each script, by the blocks of Unicode; 0 is no letter. Letters elsewhere are "other".
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F), (0xFB13, 0xFB17)),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "syriac": ((0x700, 0x74F),),
    "thaana": ((0x780, 0x7BF),),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "oriya": ((0xB00, 0xB7F),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)),
    "khmer": ((0x1780, 0x17FF),),
    "mongolian": ((0x1800, 0x18AF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
SCRIPT_OF = {name: k for k, name in enumerate(("none", *RANGES, "other"))}
N_SCRIPTS = len(SCRIPT_OF)


def _scripts() -> np.ndarray:
    """The script of each code point that may be a letter; 0 for marks, digits and signs, also those within the ranges."""
    s = np.full(0x40000, SCRIPT_OF["other"], np.uint8)
    for name, ranges in RANGES.items():
        for low, high in ranges:
            s[low : high + 1] = SCRIPT_OF[name]
    return np.where(np.fromiter((chr(c).isalpha() for c in range(len(s))), bool, len(s)), s, 0).astype(np.uint8)


SCRIPTS = _scripts()


def letter_scripts(buf: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the script of the letter that begins there; 0 elsewhere."""
    out = np.where(buf < 0x80, SCRIPTS[np.minimum(buf, 0x7F)], 0).astype(np.uint8)
    lead = np.flatnonzero(buf >= 0xC2)
    if len(lead):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        b = [padded[lead + k].astype(np.int64) for k in range(4)]
        low = [x & 0x3F for x in b]
        two, three, four = (b[0] & 0x1F) << 6 | low[1], (b[0] & 0xF) << 12 | low[1] << 6 | low[2], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3]
        code = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
        out[lead] = np.where(code < len(SCRIPTS), SCRIPTS[np.minimum(code, len(SCRIPTS) - 1)], 0)
    return out


def trigrams(w: W.Words) -> np.ndarray:
    """The bucket of the three bytes that end at each byte; a text begins behind zeros, whatever stands before it in the buffer."""
    b = w.buf.astype(np.uint32)
    one, two = np.zeros_like(b), np.zeros_like(b)
    one[1:], two[2:] = b[:-1], b[:-2]
    first = w.offsets[w.offsets < len(b)]
    one[first] = 0
    two[first] = 0
    two[first[first + 1 < len(b)] + 1] = 0
    return (b | one << np.uint32(8) | two << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(16)


def word_scripts(w: W.Words) -> np.ndarray:
    return np.maximum.reduceat(letter_scripts(w.buf), w.start) if len(w.start) else np.zeros(0, np.uint8)


COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _count(batches):
    grams: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for i, j, buf, at in W.chunks(batch.column(0)):
            w = W.split(buf, at, lower=True)
            h, solid, script = trigrams(w), ~W._SPACE[w.buf], letter_scripts(w.buf)
            code = {x: k for k, x in enumerate(dict.fromkeys(langs[i:j]))}
            of = np.repeat(np.array([code[x] for x in langs[i:j]]), np.diff(at))
            for x, k in code.items():
                here = of == k
                c = grams.setdefault(x, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                c[:BUCKETS] += np.bincount(h[here & solid], minlength=BUCKETS)
                c[BUCKETS:] += np.bincount(script[here], minlength=N_SCRIPTS)
    for x, c in grams.items():
        at = np.flatnonzero(c)
        yield W.table(COUNTS, [x] * len(at), at.astype(np.int32), c[at])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:].astype(float)
        scripts[:, 0] = 0
        self.log = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        out = share < MIN_SHARE
        out[:, out.all(axis=0)] = False
        out[:, 0] = False
        self.ruled_out = np.where(out.T, RULED_OUT, 0.0)

    def word_scores(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        h, space, script = trigrams(w), W._SPACE[w.buf], word_scripts(w)
        s = np.empty((len(w.start), len(self.langs)))
        for k in range(len(self.langs)):
            g = self.log[k][h]
            g[space] = 0
            s[:, k] = np.add.reduceat(g, w.start) if len(w.start) else 0
        s += self.ruled_out[script]
        s[script == 0] = 0
        return s, script


def viterbi(s: np.ndarray, at: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word. Words at[d]:at[d + 1] are one text; all texts advance together, word by word."""
    n = np.diff(at)
    by = np.argsort(-n, kind="stable")
    at, n = at[:-1][by], n[by]
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(steps), side="left")  # texts longer than t
    label = np.zeros(len(s), np.int32)
    if not steps:
        return label
    back, best = [], []
    v = s[at[: live[0]]].copy()
    for t in range(1, steps):
        v = v[: live[t]]
        top = v.argmax(axis=1)
        jump = v[np.arange(len(v)), top] - penalty
        moved = v < jump[:, None]
        back.append(moved)
        best.append(top)
        dropped = np.where(moved, jump[:, None], v)
        v = dropped + s[at[: live[t]] + t]
        v -= v.max(axis=1, keepdims=True)
    # Where a text ends, its last word takes the best state; ties take the first language.
    state = np.zeros(len(n), np.int64)
    ends = s[at[: live[0]]].copy()
    for t in range(1, steps):  # the states at each end: the same recursion, kept for the texts that end at t
        done = ends[live[t] :]
        state[live[t] : len(ends)] = done.argmax(axis=1)
        ends = ends[: live[t]]
        top, moved = best[t - 1], back[t - 1]
        jump = ends[np.arange(len(ends)), top] - penalty
        ends = np.where(moved, jump[:, None], ends) + s[at[: live[t]] + t]
        ends -= ends.max(axis=1, keepdims=True)
    state[: len(ends)] = ends.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        now = slice(0, live[t])
        label[at[now] + t] = state[now]
        if t:
            k = np.arange(live[t])
            moved = back[t - 1][k, state[now]]
            state[now] = np.where(moved, best[t - 1], state[now])
    return label


def train(docs: DataFrame) -> Model:
    """All labelled languages are learned; the model holds BUCKETS numbers for each."""
    counts = docs.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # at most BUCKETS + N_SCRIPTS numbers for each language
    langs = sorted(set(got["lang"]))
    out = np.zeros((len(langs), BUCKETS + N_SCRIPTS), np.int64)
    np.add.at(out, (np.searchsorted(langs, got["lang"].to_numpy(str)) if langs else [], got["bucket"].to_numpy()), got["n"].to_numpy())
    return Model(langs, out)


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score; spans adds [first word, word after the last, language] of each span."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(2)
            for i, j, buf, at in W.chunks(texts):
                w = W.split(buf, at, lower=True)
                pred, score, found = ["und"] * (j - i), np.zeros(j - i), [[] for _ in range(j - i)]
                if m.langs:
                    s, script = m.word_scores(w)
                    label = viterbi(s, w.at)
                    weight = np.where(script > 0, w.end - w.start, 0)
                    doc = W.segment_ids(w.at)
                    mass = np.bincount(doc * len(m.langs) + label, weight, (j - i) * len(m.langs)).reshape(j - i, -1)
                    total, top = mass.sum(axis=1), mass.argmax(axis=1)
                    ascii_letter = np.zeros(j - i, bool)
                    ascii_letter[doc[np.maximum.reduceat((w.buf >= 97) & (w.buf <= 122), w.start)] if len(w.start) else []] = True
                    for d in range(j - i):
                        if ascii_letter[d] or any(c.isalpha() for c in texts[i + d].as_py() or ""):
                            pred[d] = m.langs[top[d]]
                            score[d] = mass[d, top[d]] / total[d] if total[d] else 1 / len(m.langs)
                    if spans:
                        cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]) if len(label) else np.zeros(0, int)
                        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(label)], strict=True) if len(cut) else ():
                            found[doc[a]].append({"start": a - int(w.at[doc[a]]), "end": b - int(w.at[doc[a]]), "lang": m.langs[label[a]]})
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(2)), pa.array(pred), pa.array(score), *([pa.array(found, kind)] if spans else [])], names=["doc_id", "held_out", "lang_pred", "score", *(["spans"] if spans else [])])

    schema = "doc_id long, held_out boolean, lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")
    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    return predict(docs, train(docs.where("not held_out and lang is not null and text is not null")), spans=True)
