"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if at least 0.8 of its different five-word shingles occur there; an item of m words, m below
five, is one shingle of m words, which the document may have at any place. Items are far shorter than
documents, so whole-document signatures would tell nothing. A document is first reduced, for each width of shingles, to those that occur
in any item, each once, in order (no other can count), and that sequence is cut for each size class of items into overlapping segments
about as long as the class's items; between sets of like size a containment of 0.8 is a Jaccard similarity of 0.29 or more. MinHash
signatures of segments are looked up in the signatures of the class's items with one row to a band: 128 bands miss such a pair with
probability 1e-19, and sets of one shingle never. Every candidate is verified on the shingles themselves over the whole document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.llm.common import written

SHINGLE, CONTAINMENT = 5, 0.8
BANDS = 128
#: Items of one pass over the documents; more take a pass for each such block, one after the other.
ITEMS = 50_000
MEMO_WORDS = 150_000
_BITMAP = 1 << 22
_rng = np.random.default_rng(20_240_229)
_ODD = _rng.integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_C = np.uint64(0x9E3779B97F4A7C15)
_memo: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def forget_words() -> None:
    _memo.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    for w in {*words}.difference(_memo):
        _memo[w] = xxh64_intdigest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each shingle of ``size`` words in order, from the words' hashes."""
    n = len(w) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + n]) * _C
        h ^= h >> np.uint64(29)
    return h


def shingles(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def first_of_each(h: np.ndarray) -> np.ndarray:
    """Different values in the order in which they come."""
    return h[np.sort(np.unique(h, return_index=True)[1])]


def size_class(n: int) -> int:
    """Class k holds sets of up to 2**k shingles."""
    return (max(n, 1) - 1).bit_length()


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash of consecutive runs of h, one row for each run."""
    h = h ^ (h >> np.uint64(31))
    return np.column_stack([np.minimum.reduceat((h + _ADD[j]) * _ODD[j] ^ ((h + _ADD[j]) * _ODD[j] >> np.uint64(32)), starts) for j in range(BANDS)])


class ItemIndex:
    """Items by the width of their shingles (five words, or all the words of shorter ones) and size class."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        kept = [(i, words) for i, text in items if (words := words_of(text))]
        self.ids = [i for i, _ in kept]
        self.words = [words for _, words in kept]
        self.width = [min(SHINGLE, len(words)) for words in self.words]
        self.hashes = [first_of_each(shingle_hashes(word_hashes(w), k)) for w, k in zip(self.words, self.width, strict=True)]
        self.need = [math.ceil(CONTAINMENT * len(h) - 1e-9) for h in self.hashes]
        self.widths = sorted({*self.width})
        self.all = {}
        self.bitmap = np.zeros(_BITMAP, bool)
        by: dict[tuple[int, int], list[int]] = {}
        for k, h in enumerate(self.hashes):
            by.setdefault((self.width[k], size_class(len(h))), []).append(k)
        for width in self.widths:
            self.all[width] = np.unique(np.concatenate([h for h, k in zip(self.hashes, self.width, strict=True) if k == width]))
            self.bitmap[self._slot(self.all[width])] = True
        self.classes: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {width: {} for width in self.widths}
        for (width, c), members in by.items():
            sizes = [len(self.hashes[k]) for k in members]
            keys = self._keys(signatures(np.concatenate([self.hashes[k] for k in members]), np.cumsum([0, *sizes[:-1]]))).ravel()
            order = np.argsort(keys, kind="stable")
            self.classes[width][c] = keys[order], np.repeat(members, BANDS)[order]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _BITMAP.bit_length() + 1)).astype(np.int64)

    @staticmethod
    def _keys(signature: np.ndarray) -> np.ndarray:
        return signature ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * _C)

    def candidates(self, h: np.ndarray, width: int) -> list[int]:
        """Items whose signature meets that of a segment of h (different shingles of items of this width, in order)."""
        found: set[int] = set()
        for c, (keys, members) in self.classes[width].items():
            # blocks of a quarter of the class's largest size, five to a segment; of up to four shingles each starts a segment of its own
            block, each = (1, 1 << c) if c < 3 else (1 << c - 2, 5)
            starts = np.arange(0, len(h), block)
            least = signatures(h, starts)
            segments = least.copy()
            for k in range(1, each):
                np.minimum(segments[:-k], least[k:], out=segments[:-k])
            asked = np.unique(self._keys(segments))
            low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
                found.update(members[a:b].tolist())
        return sorted(found)

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, its shingles, those that the text has) of the items that the text contains."""
        words, out = words_of(text), []
        hashes = word_hashes(words)
        for width in self.widths:
            h = shingle_hashes(hashes, width)
            h = h[self.bitmap[self._slot(h)]]
            if not len(h):
                continue
            known = self.all[width]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            h = first_of_each(h[known[at] == h])
            near = [k for k in self.candidates(h, width) if int(np.isin(self.hashes[k], h).sum()) >= self.need[k]] if len(h) else []
            own = shingles(words, width) if near else set()
            for k in near:
                item = shingles(self.words[k], width)
                if (shared := len(item & own)) >= math.ceil(CONTAINMENT * len(item) - 1e-9):
                    out.append((self.ids[k], len(item), shared))
        return out


def item_blocks(benchmark: DataFrame, items: int) -> Iterator[tuple[list[tuple[int | None, str | None]], bool]]:
    """The items in blocks of about ``items``, one at a time on the driver, and if a block is the last one."""
    known = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = -(-known.count() // items)
    for k in range(parts):
        block = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield [(r.item_id, r.text) for r in block.collect()], k == parts - 1


def _indexes(spark: SparkSession, benchmark: DataFrame, items: int) -> Iterator[tuple[Broadcast, bool]]:
    """A broadcast index of each block, and if it is the last one. What is made with another must be written before the next is asked for,
    as it is destroyed then: one index is alive at a time, on the driver and in each worker, whatever the number of items."""
    for block, last in item_blocks(benchmark, items):
        index = spark.sparkContext.broadcast(ItemIndex(block))
        yield index, last
        if not last:
            index.destroy()


MATCH = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def contained_items(documents: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, n_shingles, n_shared, containment.

    documents: doc_id, text; benchmark: item_id, text; more columns are ignored. Texts or items that are null or without words match
    nothing; an item of fewer than five words is found wherever its words follow each other. Repeated documents have rows of
    their own (a null doc_id too); items that repeat id and text count once. Empty tables give no rows.
    """
    import pyarrow as pa

    texts, out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for index, last in _indexes(documents.sparkSession, benchmark, items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d.as_py(), *m) for d, x in zip(batch.column(0), batch.column(1), strict=True) for m in index.value.matches(x.as_py())]
                ids, items, n, shared = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / k for s, k in zip(shared, n, strict=True)], pa.float64())],
                    names=[f.split()[0] for f in MATCH.split(", ")],
                )
            forget_words()  # the worker lives on

        found = texts.mapInArrow(run, MATCH)
        found = found if last else written(found, "contained-items")
        out = found if out is None else out.union(found)
    return documents.sparkSession.createDataFrame([], MATCH) if out is None else out


def decontaminate(documents: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The documents that contain no item, with all their columns; rows never leave their partition."""
    import pyarrow as pa

    kept = documents
    at = documents.columns.index("text")
    for index, last in _indexes(documents.sparkSession, benchmark, items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.matches(x.as_py()) for x in batch.column(at)], pa.bool_()))
            forget_words()

        kept = kept.mapInArrow(run, documents.schema)
        kept = kept if last else written(kept, "decontaminated")
    return kept
