"""Token ids as length-delimited binary records, with an offset index beside them.

File format (little-endian throughout): a file is a run of frames. Frame: length of the payload (u64), masked CRC-32C of these eight bytes (u32), payload,
masked CRC-32C of the payload (u32); mask(c) = ((c >> 15 | c << 17) + 0xA282EAD8) mod 2^32. Payload: doc_id (i64, 0 where there is none), number of
ids (u32), bytes of an id (u8: 2 where all ids of the tokenizer fit, else 4), whether there is a doc_id (u8), two zero bytes, the ids.

A folder holds `records/` (the files, each a run of consecutive documents), `index/` (Parquet: a row for each record with file, offset, length, doc_id, n_tokens and
the ids before it in its file) and `files/` (Parquet: each file in order, with its records, ids and the ids of all files before it).
Documents are dealt out by ranges of doc_id and sorted, so files follow each other in ascending order. Each attempt of a task writes files of its
own names; the index, which Spark commits, names those of the attempts that count, and the others are deleted when it is written.

Defined cases: null text is empty and gives the end id alone; null doc_id comes first; rows that repeat are records of their own, in order of their texts where
a doc_id has several; an empty table gives an empty index and no files; a record whose lengths or checksums are wrong raises an error; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.shared import fresh_path

from ._stage import small_side

END = 2
FILE_BYTES, READ_BYTES = 128 << 20, 8 << 20
#: Words whose ids are remembered, and letters of a text that are cut into parts at a time.
KNOWN, SEGMENT = 1_000_000, 2 << 20
INDEX = "file string, place long, row long, offset long, length long, doc_id long, n_tokens long, before long"
HEADER = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("width", "u1"), ("has_id", "u1"), ("zero", "<u2")])


# ---- checksums
#: The reversed polynomial of CRC-32C, and the constant of the mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 512


def _tables() -> np.ndarray:
    """t[k][b]: the state after byte b and k zero bytes, from state 0."""
    t = np.zeros((8, 256), np.uint64)
    x = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        x = np.where(x & np.uint64(1), (x >> np.uint64(1)) ^ np.uint64(POLYNOMIAL), x >> np.uint64(1))
    t[0] = x
    for k in range(1, 8):
        t[k] = t[0][t[k - 1] & np.uint64(255)] ^ (t[k - 1] >> np.uint64(8))
    return t


_T = _tables()


def _bytes_of(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [((x >> np.uint64(8 * i)) & np.uint64(255)).astype(np.intp) for i in range(n)]


def _shift() -> np.ndarray:
    """s[i][b]: the state after BLOCK zero bytes, from b in byte i of the state."""
    s = np.arange(256, dtype=np.uint64)[None, :] << (np.arange(4, dtype=np.uint64) * np.uint64(8))[:, None]
    for _ in range(BLOCK):
        s = _T[0][s & np.uint64(255)] ^ (s >> np.uint64(8))
    return s


_S = _shift()


def masked_crc32c(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each of parts, of at least four bytes each; all blocks of all parts are worked on side by side.

    Zero bytes in front change nothing in state 0, so parts are filled up to whole blocks there; the first state, all ones, is folded into the first four bytes.
    """
    n = np.array([len(p) for p in parts], np.int64)
    blocks = -(-n // BLOCK)
    ends = np.cumsum(blocks)
    buf = np.zeros(int(ends[-1]) * BLOCK if len(n) else 0, np.uint8)
    for p, e in zip(parts, (ends * BLOCK).tolist(), strict=True):
        buf[e - len(p) : e] = np.frombuffer(p, np.uint8)
        buf[e - len(p) : e - len(p) + 4] ^= 255
    words = buf.view("<u8").reshape(-1, BLOCK // 8)
    state = np.zeros(len(words), np.uint64)
    for w in words.T:
        b = _bytes_of(w ^ state, 8)
        state = _T[7][b[0]]
        for i in range(1, 8):
            state = state ^ _T[7 - i][b[i]]
    out, first, live = np.zeros(len(n), np.uint64), ends - blocks, np.arange(len(n))
    for step in range(int(blocks.max(initial=0))):
        live = live[blocks[live] > step]
        b = _bytes_of(out[live], 4)
        out[live] = _S[0][b[0]] ^ _S[1][b[1]] ^ _S[2][b[2]] ^ _S[3][b[3]] ^ state[first[live] + step]
    c = (out ^ np.uint64(0xFFFFFFFF)).astype(np.uint64)
    return (((c >> np.uint64(15)) | ((c << np.uint64(17)) & np.uint64(0xFFFFFFFF))) + np.uint64(MASK)).astype(np.uint32)


# ---- encoding
class Encoder:
    """Ids by the tokenizers library. apart: the tokenizer drops spaces and merges nothing across them, so that texts can be
    cut there and the ids of parts remembered; else texts are encoded whole."""

    def __init__(self, path: str, apart: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.apart = Tokenizer.from_file(path), apart
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts = array("I"), array("q", [0, 0])

    def _add(self, word: str, ids) -> None:
        self.known[word] = len(self.starts) - 1
        self.ids.extend(ids)
        self.starts.append(len(self.ids))

    def _ask(self, words: list[str]) -> None:
        """Words of small ASCII letters are left alone before the library's model gets them, so it is asked at once."""
        pieces, rest = self.tokenizer.model.tokenize, []
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                self._add(w, [t.id for t in pieces(w)])
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self._add(w, e.ids)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The place of each word in starts; words that are not known are asked."""
        coded = words.dictionary_encode()
        each = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in each if w not in self.known]
        if new:
            if len(self.known) + len(new) > KNOWN:
                self._forget()
                new = [w for w in each if w]
            self._ask(new)
        return np.fromiter(map(self.known.__getitem__, each), np.int64, len(each))[coded.indices.to_numpy()]

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts, one after the other, number of ids of each). Parts stand between spaces or line ends, which the tokenizer drops.

        It lowers letters, so parts in ASCII are lowered here. ASCII words before one mark are encoded without it: letters and marks are never one piece.
        """
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        part = coded.dictionary
        part = pc.if_else(pc.and_(pc.string_is_ascii(part), pc.invert(pc.match_substring(part, "<|"))), pc.ascii_lower(part), part)
        marked = pc.match_substring_regex(part, "^[a-z]+[.,;:!?]$")
        both = [pc.if_else(marked, pc.utf8_slice_codeunits(part, 0, -1), part), pc.if_else(marked, pc.utf8_slice_codeunits(part, -1), "")]
        number = self._numbers(pa.concat_arrays([x.cast(pa.large_string()) for x in both])).reshape(2, -1)
        number = number.T[coded.indices.to_numpy()].ravel()  # of each part its word and its mark, which may be empty
        ids, starts = np.array(self.ids, np.uint32), np.array(self.starts, np.int64)
        n = starts[number + 1] - starts[number]
        total = np.cumsum(n)
        out = ids[np.repeat(starts[number] - total + n, n) + np.arange(int(total[-1]) if len(n) else 0)]
        ends = cut.offsets.to_numpy()[1:] * 2
        return out, np.diff(np.concatenate([[0], total[ends - 1]]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END behind it; number of ids of each)."""
        if not self.apart:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids, n = np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(x) for x in each], np.int64)
        else:
            pieces, owner, held, done = [], [], 0, []
            for d, text in enumerate(texts):
                at = 0
                while at < len(text) or at == 0:  # segments end at a space, whatever the length of a text
                    stop = text.find(" ", at + SEGMENT) if len(text) - at > SEGMENT else -1
                    pieces.append(text[at:] if stop < 0 else text[at:stop])
                    owner.append(d)
                    held += len(pieces[-1])
                    if held >= SEGMENT:
                        done.append(self._parts(pieces))
                        pieces, held = [], 0
                    if stop < 0:
                        break
                    at = stop + 1
            if pieces:
                done.append(self._parts(pieces))
            ids = np.concatenate([x[0] for x in done]) if done else np.zeros(0, np.uint32)
            n = np.bincount(owner, np.concatenate([x[1] for x in done]), minlength=len(texts)).astype(np.int64) if done else np.zeros(len(texts), np.int64)
        return np.insert(ids, np.cumsum(n), END), n + 1


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, apart: bool) -> Encoder:
    """A worker keeps what it knows from task to task."""
    if (path, apart) not in _ENCODERS:
        _ENCODERS[path, apart] = Encoder(path, apart)
    return _ENCODERS[path, apart]


# ---- files
def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The shared folder as workers reach it: a local mount, or a store that pyarrow knows."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def frames(doc_ids: list, ids: np.ndarray, n: np.ndarray, width: int) -> list[bytes]:
    heads = np.zeros(len(n), HEADER)
    heads["doc_id"], heads["has_id"] = [d or 0 for d in doc_ids], [d is not None for d in doc_ids]
    heads["n"], heads["width"] = n, width
    body, end = ids.astype(f"<u{width}"), np.cumsum(n)
    payloads = [heads[i].tobytes() + body[e - k : e].tobytes() for i, (e, k) in enumerate(zip(end.tolist(), n.tolist(), strict=True))]
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    crc = masked_crc32c(lengths + payloads).astype("<u4")
    return [b"".join((size, crc[i].tobytes(), p, crc[len(n) + i].tobytes())) for i, (size, p) in enumerate(zip(lengths, payloads, strict=True))]


def unframe(parts: list[memoryview]) -> list[memoryview]:
    """Payloads of whole frames, whose checksums are compared."""
    lengths, payloads = [bytes(p[:8]) for p in parts], [p[12:-4] for p in parts]
    stored = np.array([int.from_bytes(p[8:12], "little") for p in parts] + [int.from_bytes(p[-4:], "little") for p in parts], np.uint32)
    if len(parts) and not (masked_crc32c(lengths + [bytes(p) for p in payloads]) == stored).all():
        raise ValueError("a record is damaged: its checksum differs")
    return payloads


def parse(payload) -> tuple[int | None, np.ndarray]:
    head = np.frombuffer(payload, HEADER, 1)[0]
    ids = np.frombuffer(payload, f"<u{head['width']}", offset=HEADER.itemsize)
    if len(ids) != head["n"]:
        raise ValueError("a record is damaged: its length differs")
    return (int(head["doc_id"]) if head["has_id"] else None), ids.astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, apart: bool = True, file_bytes: int = FILE_BYTES) -> None:
    """Encode docs (doc_id, text) and write them to path, a new folder that driver and workers share. tokenizer: a file on every machine."""
    folder = f"{path.rstrip('/')}/records"

    def run(batches):
        codec = encoder(tokenizer, apart)
        where, root = _file_system(folder)
        task, out, files = TaskContext.get().partitionId(), None, 0
        try:
            for batch in batches:
                ids, n = codec.encode([t or "" for t in batch.column(1).to_pylist()])
                doc_ids = batch.column(0).to_pylist()
                made, at = frames(doc_ids, ids, n, codec.width), 0
                while at < len(made):
                    if out is None:
                        name, place, files = f"{task:06d}-{files:04d}-{uuid.uuid4().hex}.rec", (task << 32) + files, files + 1
                        where.create_dir(root, recursive=True)
                        out, offset, row, before = where.open_output_stream(f"{root}/{name}"), 0, 0, 0
                    sizes = np.cumsum([len(f) for f in made[at:]])
                    k = max(1, int(np.searchsorted(sizes, file_bytes - offset, side="right"))) if offset + sizes[-1] > file_bytes else len(sizes)
                    part, counts = slice(at, at + k), n[at : at + k]
                    out.write(b"".join(made[part]))
                    length = np.diff(sizes[:k], prepend=0)
                    table = {"file": [name] * k, "place": [place] * k, "row": row + np.arange(k), "offset": offset + sizes[:k] - length, "length": length, "doc_id": pa.array(doc_ids[part], pa.int64()), "n_tokens": counts, "before": before + np.cumsum(counts) - counts}
                    yield pa.RecordBatch.from_pydict(table)
                    offset, row, before, at = offset + int(sizes[k - 1]), row + k, before + int(counts.sum()), at + k
                    if offset >= file_bytes or at < len(made):
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()

    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_of"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange("doc_id", "_of", "_row").sortWithinPartitions("doc_id", "_of", "_row")
    rows.select("doc_id", "text").mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    each = spark.read.parquet(f"{path}/index").groupBy("place", "file").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("ids"), F.sum("length").alias("bytes"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    each = each.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("records").over(before), F.lit(0)))
    each.write.parquet(f"{path}/files")
    _tidy(spark, path)


def _tidy(spark: SparkSession, path: str) -> None:
    """Delete the files of attempts that do not count."""
    named = {r[0] for r in spark.read.parquet(f"{path}/files").select("file").collect()}  # a name for each FILE_BYTES
    where, root = _file_system(f"{path}/records")
    for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.base_name not in named:
            where.delete_file(f.path)


READ = "doc_id long, start long, n_tokens long, ids binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens, ids (unsigned, 32 bits, little-endian) of each record, by reading the files from end to end."""
    folder = f"{path}/records"

    def run(batches):
        where, root = _file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_stream(f"{root}/{name}") as f:
                    held, need = b"", 0
                    while got := f.read(max(READ_BYTES, need - len(held))):
                        held, at, parts = held + got, 0, []
                        view = memoryview(held)
                        while len(held) - at >= 8:
                            need = 16 + int.from_bytes(view[at : at + 8], "little")
                            if len(held) - at < need:
                                break
                            parts.append(view[at : at + need])
                            at += need
                        made = [parse(p) for p in unframe(parts)]
                        held, need = held[at:], need if len(held) - at >= 8 else 0
                        if made:
                            n = np.array([len(x) for _, x in made], np.int64)
                            starts = start + np.cumsum(n) - n
                            start += int(n.sum())
                            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], pa.int64()), pa.array(starts), pa.array(n), pa.array([x.tobytes() for _, x in made], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    if held:
                        raise ValueError(f"{name} ends within a record")

    files = spark.read.parquet(f"{path}/files").select("file", "start")
    return files.repartition("file").mapInArrow(run, READ)


def read_some(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of wanted, rows of `index/` in any order (a shuffled epoch, a batch): each is read at its offset. doc_id, start, n_tokens, ids."""
    folder = f"{path}/records"

    def run(batches):
        where, root = _file_system(folder)
        files: dict[str, pa.NativeFile] = {}
        for batch in batches:
            for file, offset, length, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if file not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[file] = where.open_input_file(f"{root}/{file}")
                doc_id, ids = parse(unframe([memoryview(files[file].read_at(length, offset))])[0])
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([start]), pa.array([len(ids)]), pa.array([ids.tobytes()], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.parquet(f"{path}/files").select("file", "start")
    return wanted.join(small_side(files), "file").select("file", "offset", "length", (F.col("start") + F.col("before")).alias("start")).mapInArrow(run, READ)


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """Rows of the index in an order drawn by seed, for read_some."""
    return spark.read.parquet(f"{path}/index").orderBy(F.xxhash64(F.lit(seed), "place", "row"), "place", "row")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_token_records(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path())
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
