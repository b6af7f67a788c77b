"""Terms of whole texts with their positions: each text is split by itself in its task, so no token becomes a row and nothing is exchanged or sorted for it."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.functions.text import MAX_TERM, porter_stem

_OTHER = re.compile("[^a-z0-9]")
COLUMNS = ["term", "doc_id", "positions", "tf", "n_tokens", "n_terms"]
#: Words whose terms a task remembers, and rows of a batch that it gives.
KNOWN, ROWS = 500_000, 100_000
#: Rows that are packed together for an exchange, and at most in a batch that comes out of it.
PACKED, UNPACKED = 800_000, 50_000


def _split(text: str) -> list[str]:
    """As text.DELIMITERS splits."""
    return text.replace("\n", " ").replace("\t", " ").replace("<", " ").split(" ")


def _positions(texts: list[str], stop: frozenset, known: dict[str, str], term_of: Callable[[str], str]) -> dict[str, list[int]]:
    """The positions of each term, in order, as text.tokens gives them. Several texts are rows of one doc_id: their words of one place advance together."""
    found: dict[str, list[int]] = {}
    pos = -1
    for raws in zip_longest(*map(_split, texts)) if len(texts) > 1 else ((r,) for r in _split(texts[0])):
        raws = [r for r in raws if r is not None and r not in stop] if stop or len(texts) > 1 else raws
        for raw in raws:
            pos += len(raw) + 1
        for raw in raws:
            if (term := known.get(raw)) is None:
                term = known[raw] = term_of(raw)
            if term:
                if (at := found.get(term)) is None:
                    found[term] = [pos]
                else:
                    at.append(pos)
    return found


@dataclass(frozen=True)
class Layout:
    """Which file a posting goes to: the pairs (term, doc_id) at which the second and all later files begin, ascending; behind them stand files for the sizes of documents, parted by
    doc_id. A term in many texts begins several files. id_type: of doc_id."""

    bounds: tuple[tuple[str, int], ...] = ()
    pages: tuple[int, ...] = ()
    id_type: str = "long"

    @property
    def files(self) -> int:
        return len(self.bounds) + len(self.pages) + 2

    def of(self, codes: np.ndarray, terms: list[str | None], ids: pa.Array) -> np.ndarray:
        """The files of rows, given as codes of terms and doc_ids; a null doc_id comes first."""
        ids = np.asarray(ids.cast(pa.int64()).fill_null(-(1 << 63)))
        ends = [(len(self.bounds) + 1, self.pages) if t is None else self._of_term(t) for t in terms]
        out = np.array([f for f, _ in ends], np.int32)[codes]
        for code, (_, docs) in enumerate(ends):
            if docs:
                at = np.flatnonzero(codes == code)
                out[at] += np.searchsorted(docs, ids[at], "right").astype(np.int32)
        return out

    def _of_term(self, term: str) -> tuple[int, list[int]]:
        first = bisect_left(self.bounds, (term,))
        return first, [d for _, d in self.bounds[first : bisect_right(self.bounds, term, key=lambda b: b[0])]]


def cells(low: int, width: int, size: str):
    """For mapInArrow over (term, doc_id, tf, sizes) in order of the first two: term, block, n, first, last, best of each run of one term in one range of doc_id. A run that ends
    with its batch goes on as another row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            if not len(batch):
                continue
            ids = np.asarray(batch.column("doc_id")).astype(np.int64)
            block = (ids - low) // width
            terms = np.asarray(batch.column("term").dictionary_encode().indices)
            at = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])]))
            ends = np.append(at[1:], len(ids))
            best = np.maximum.reduceat(np.asarray(batch.column("tf")) / np.asarray(batch.column(size)), at)
            columns = [batch.column("term").take(pa.array(at)), *map(pa.array, (block[at].astype(np.int32), ends - at, ids[at], ids[ends - 1], best))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "first", "last", "best"])

    return run


def packed(batch: pa.RecordBatch, layout: Layout) -> pa.RecordBatch:
    """file, rows: the rows of a batch of COLUMNS that go to each file, in order of the terms, as one compressed Arrow batch: a third of what single rows take in an exchange."""
    coded = batch.column("term").dictionary_encode("encode")
    codes = np.asarray(coded.indices)
    file = layout.of(codes, coded.dictionary.to_pylist(), batch.column("doc_id"))
    rank = np.argsort(np.asarray(pc.sort_indices(coded.dictionary)))
    order = np.lexsort((rank[codes], file))
    batch, file = batch.take(pa.array(order)), file[order]
    at = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]]))
    out = []
    for a, z in zip(at, np.append(at[1:], len(file)), strict=True):
        raw = batch.slice(a, z - a).serialize()
        out.append(raw.size.to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(file[at]), pa.array(out, pa.binary())], ["file", "rows"])


def packer(layout: Layout):
    """For mapInArrow over COLUMNS: packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for together in _together(batches, PACKED):
            yield packed(together, layout)

    return run


def unpacker(layout: Layout):
    """For mapInArrow over rows of packed: COLUMNS again."""
    kinds = [pa.string(), {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64()}[layout.id_type], pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(COLUMNS, kinds, strict=True)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("rows"):
                raw = x.as_buffer()
                size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
                yield pa.ipc.read_record_batch(pa.decompress(raw.slice(8), size, "zstd"), schema)

    return lambda batches: _together(each(batches), UNPACKED)


def _together(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: of `rows` rows, unless one of batches has more."""
    have: list[pa.RecordBatch] = []
    for batch in batches:
        if have and sum(map(len, have)) + len(batch) > rows:
            yield from pa.Table.from_batches(have).combine_chunks().to_batches()
            have = []
        if len(batch):
            have.append(batch)
    if have:
        yield from pa.Table.from_batches(have).combine_chunks().to_batches()


def splitter(stopwords: Iterable[str] = (), stem: bool = False, words: Iterable[str] | None = None, patterns: Iterable[str] = (), sizes: bool = False, layout: Layout | None = None):
    """For mapInArrow over (doc_id, texts): term, doc_id, positions, tf, n_tokens, n_terms of each term of a text; of words and those that fit patterns only, if words are given.

    sizes: doc_id, n_tokens, n_terms of each text with a token instead. layout: long terms are left out, each text with a token has a row without a term,
    which tells its sizes, and all are packed by the files they go to.
    """
    stop, asked = frozenset(stopwords or ()), None if words is None else frozenset(words)
    rx = re.compile("|".join(f"(?:{p})" for p in patterns)) if patterns else None
    most = ROWS if layout is None else PACKED

    def term_of(raw: str) -> str:
        term = _OTHER.sub("", raw.lower())
        return porter_stem(term) if stem and term else term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        fits: dict[str, bool] = {}
        terms, rows, flat, tf, n_tokens, n_terms = [], [], array("i"), array("i"), array("i"), array("i")

        def batch_out(ids):
            doc = ids.take(pa.array(np.array(rows, np.int64)))
            three = [pa.array(np.array(x, np.int32)) for x in (tf, n_tokens, n_terms)]
            if sizes:
                return pa.RecordBatch.from_arrays([doc, *three[1:]], ["doc_id", "n_tokens", "n_terms"])
            ends = np.concatenate([[0], np.cumsum(np.array(tf, np.int64))]).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, np.int32)))
            names = pa.array(terms, pa.string())
            columns = [names, doc, positions, *three]
            if layout is None:
                return pa.RecordBatch.from_arrays(columns, COLUMNS)
            return packed(pa.RecordBatch.from_arrays(columns, COLUMNS), layout)

        def clear():
            for x in (terms, rows, flat, tf, n_tokens, n_terms):
                del x[:]

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for row in range(len(batch)):
                found = _positions(texts[row].as_py(), stop, known, term_of)
                if not found:
                    continue
                size, short = sum(map(len, found.values())), sum(len(t) < MAX_TERM for t in found)
                if sizes:
                    found = {"": ()}
                elif asked is not None:
                    for t in found:
                        if t not in fits:
                            fits[t] = t in asked or (rx is not None and rx.search(t) is not None)
                    found = {t: p for t, p in found.items() if fits[t]}
                elif layout is not None:
                    found = {t: p for t, p in found.items() if len(t) < MAX_TERM} | {None: ()}
                terms.extend(found)
                rows.extend([row] * len(found))
                n_tokens.extend([size] * len(found))
                n_terms.extend([short] * len(found))
                for p in found.values():
                    flat.extend(p)
                    tf.append(len(p))
                if len(known) > KNOWN:
                    known.clear()
                if len(fits) > KNOWN:
                    fits.clear()
                if len(rows) >= most or len(flat) >= 4 * most:
                    yield batch_out(ids)
                    clear()
            if rows:
                yield batch_out(ids)
                clear()

    return run
