"""Byte-level BPE by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens lists the matches in a piece of text; the longest at each
position are tried from left to right. A token may follow another only if merging the two in rank
order would leave that border alone (the pair-compatibility table, filled as pairs turn up). Where no
token fits, the encoder steps back and takes the next shorter token; a position that has failed is never
tried again, so the work is linear. The result equals greedy merging by rank.

Defined cases: null text is empty and has no tokens; an added special token in the text becomes its id;
every row of the input, also a repeated one, gives one row; null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: Fixed values of the byte-level format: white space, and the pieces that merges never cross.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CACHE_ENTRIES, CACHE_LETTERS = 200_000, 64
MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for word, i in vocab.items():
            if word not in self.special:
                spelled[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            spelled[i] = word.encode()
        #: The offset table: token i is table[starts[i]:starts[i + 1]].
        self.table, self.starts = b"".join(spelled), [0]
        for b in spelled:
            self.starts.append(self.starts[-1] + len(b))
        self.bytes, self.first = np.frombuffer(self.table, np.uint8), np.array(self.starts)
        self.id_of = {b: i for i, b in enumerate(spelled) if i not in self.special.values()}
        self.length = [len(b) for b in spelled]
        #: merged[a, b] and, for each token, the two it was merged from and the rank of that merge.
        self.merged, self.parts, self.rank = {}, [None] * size, [-1] * size
        for r, m in enumerate(file["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[a, b] = whole
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = (a, b), r
        auto = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            auto.add_word(b.decode("latin-1"), (len(b), i))
        auto.make_automaton()
        self.auto, self.shorter, self.pairs = auto, {}, {}
        self.pieces = regex.compile(PIECES)
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tangled = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")
        #: Pieces of late and those before them: a bounded memory of results.
        self.fresh: dict[str, str] = {}
        self.stale: dict[str, str] = {}

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of token."""
        if token not in self.shorter:
            b = self.table[self.starts[token] : self.starts[token + 1]]
            self.shorter[token] = next((i for n in range(len(b) - 1, 0, -1) if (i := self.id_of.get(b[:n])) is not None), None)
        return self.shorter[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b in rank order gives just a and b.

        Undo the later merge of the two sides again and again; if at any moment the tokens that meet at the
        border would merge earlier than what still has to be merged there, the border does not hold.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        left, right, rank, parts, merged = a, b, self.rank, self.parts, self.merged
        # (rank, side) of the merge that comes next after the present state; none yet
        limit, ok = (len(self.rank) + 1, 0), True
        while True:
            whole = merged.get((left, right))
            # equal ranks apply from left to right: a merge inside a comes before one at the border, that before one inside b
            if whole is not None and (rank[whole], 1) < limit:
                ok = False
                break
            after_left, after_right = (rank[left], 0), (rank[right], 2)
            if rank[left] < 0 and rank[right] < 0:
                break
            if after_left > after_right:
                limit, left = after_left, parts[left][1]
            else:
                limit, right = after_right, parts[right][0]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.id_of.get(piece)
        if whole is not None and self.rank[whole] < 0:
            return [whole]
        longest: dict[int, tuple[int, int]] = {}
        for end, match in self.auto.iter(piece.decode("latin-1")):
            longest[end + 1 - match[0]] = match  # ends ascend, so the last match from a start is its longest
        out: list[int] = []
        n, at, last, known, dead, token = len(piece), 0, -1, self.pairs, None, longest[0][1]
        while at < n:
            while True:
                end = at + self.length[token]
                if dead is None or end not in dead:
                    fits = True
                    if last >= 0:
                        fits = known.get((last, token))
                        if fits is None:
                            fits = self.compatible(last, token)
                    if fits:
                        out.append(token)
                        last, at = token, end
                        if at < n:
                            token = longest[at][1]
                        break
                shorter = self.next_shorter(token)
                while shorter is None:  # nothing fits here: step back, and never come here again
                    dead = dead or set()
                    dead.add(at)
                    back = out.pop()
                    at -= self.length[back]
                    last = out[-1] if out else -1
                    shorter = self.next_shorter(back)
                token = shorter
        return out

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        n = self.first[ids + 1] - self.first[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.first[ids] - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)].tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.fromstring(",".join(self.records(text)), np.int64, sep=",") if text else np.zeros(0, np.int64)

    def piece(self, text: str) -> str:
        got = self.stale.get(text)
        if got is None:
            got = ",".join(map(str, self.encode_piece(text.encode())))
        if len(text) <= CACHE_LETTERS:
            self.fresh[text] = got
            if len(self.fresh) >= CACHE_ENTRIES:
                self.stale, self.fresh = self.fresh, {}
        return got

    def record(self, part: str) -> str:
        """A part that is no piece of late: words, and words before a mark, are told apart without the pattern."""
        known = self.fresh.get
        if part[-1] in MARKS:
            head = part[:-1]
            if (head[1:] if head[:1] == " " else head).isalpha():
                return (known(head) or self.piece(head)) + "," + (known(part[-1]) or self.piece(part[-1]))
        elif (part[1:] if part[0] == " " else part).isalpha():
            return self.piece(part)
        return ",".join([known(p) or self.piece(p) for p in self.pieces.findall(part)])

    def plain(self, text: str) -> list[str]:
        """Ids of the parts of a text without special tokens.

        A cut before a space is a border of pieces unless white space stands on both of its sides; a text
        with such a place is cut into pieces as a whole.
        """
        if self.tangled.search(text):
            parts = self.pieces.findall(text)
        else:
            first, *more = text.split(" ")
            parts = ([first] if first else []) + [" " + x for x in more]
        make = self.record
        return [self.fresh.get(p) or make(p) for p in parts]

    def records(self, text: str) -> list[str]:
        """Ids, as text, of consecutive parts of the text."""
        out, at = [], 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            if m.start() > at:
                out += self.plain(text[at : m.start()])
            out.append(str(self.special[m[0]]))
            at = m.end()
        return out + (self.plain(text[at:]) if at < len(text) else [])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, with_text: bool = False, with_ids: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with_ids adds the ids, with_text the decoded text.

    path: a vocabulary file of the tokenizers library on every machine (byte-level BPE). columns: kept besides, as own_<name> where a name is taken.
    """
    more = [*((c, docs.schema[c].dataType) for c in columns), *([("ids", ArrayType(IntegerType()))] if with_ids else []), *([("decoded", "string")] if with_text else [])]
    schema = StructType()
    for name, kind in (("doc_id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *((f"_c{i}", t) for i, (_, t) in enumerate(more))):
        schema.add(name, kind)
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)]

    def run(batches):
        c = codec(path)
        for batch in batches:
            counts, digests, back, all_ids, texts = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                ids = ",".join(c.records(text)) if text else ""
                numbers = np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)
                raw = c.decode(numbers)
                counts.append(len(numbers))
                digests.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    all_ids.append(numbers.astype(np.int32))
                if with_text:
                    texts.append(raw.decode("utf-8", "replace"))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string()), *(batch.column(2 + i) for i in range(len(columns)))]
            arrays += ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []) + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(f"_c{i}" for i in range(len(more)))])

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *kept).mapInArrow(run, schema)
    fixed = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    taken = (*fixed, "ids", "decoded")
    return out.select(*fixed, *[F.col(f"_c{i}").alias(f"own_{c}" if i < len(columns) and c in taken else c) for i, (c, _) in enumerate(more)])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
