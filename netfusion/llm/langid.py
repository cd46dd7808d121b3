"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of its typical character trigrams, and all filters share their hash functions, so they are stored
bit-sliced: a slot holds one bit for each language. The AND of a trigram's slots is the set of all languages that contain it. A text
is decided by the bits' counts per language, corrected for the share of slots that each filter fills by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfusion.llm.common import bucket_of, cut

SLOTS = 1 << 18
HASHES = 3
GRAMS = 8000
LEAST_COUNT = 3
#: A trigram is typical of a language if it is at least this share as frequent there as where it is most frequent.
TYPICAL = 0.2
#: Rows of each language that the filters are fitted on: all if fewer than twice as many, else about this many chosen by a hash of the id.
SAMPLE_DOCS = 2000
#: With more languages than this their sampling rates are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"
_SPACE = 32
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str) -> tuple[np.ndarray, int]:
    """Code points of the lower-cased text, each run of anything but letters as one space, a space around; and the number of letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[codes]
    n = int(is_letter.sum())
    spaced = np.concatenate([[_SPACE], np.where(is_letter, codes, _SPACE), [_SPACE]]).astype(np.uint64)
    return spaced[np.append(True, (spaced[1:] != _SPACE) | (spaced[:-1] != _SPACE))], n


def trigrams(text: str) -> np.ndarray:
    """Trigrams packed into 63 bits; empty for a text without letters."""
    c, n = letters(text)
    if not n:
        return np.zeros(0, np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]


def slots_of(grams: np.ndarray, k: int, slots: int) -> np.ndarray:
    mixed = (grams ^ (grams >> np.uint64(31))) * _MULTIPLIERS[k]
    return ((mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIERS[3] >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # slots x words of 64 languages
    chance: np.ndarray  # share of trigrams that a language's filter takes by chance

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """For each trigram the languages that contain it, as words of 64 bits."""
        out = self.table[slots_of(grams, 0, len(self.table))]
        for k in range(1, HASHES):
            out &= self.table[slots_of(grams, k, len(self.table))]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = trigrams(text or "")
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        masks = self.bits(grams)
        hits = np.array([np.count_nonzero(masks[:, i >> 6] & np.uint64(1 << (i & 63))) for i in range(len(self.languages))])
        true = np.clip((hits - len(grams) * self.chance) / (1 - self.chance), 0, None)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true[best] > 0 else 0.0


def build(grams_of: dict[str, np.ndarray], slots: int = SLOTS) -> Filters:
    languages = sorted(grams_of)
    table = np.zeros((slots, -(-len(languages) // 64) or 1), np.uint64)
    for i, name in enumerate(languages):
        for k in range(HASHES):
            table[slots_of(grams_of[name], k, slots), i >> 6] |= np.uint64(1 << (i & 63))
    fill = np.array([np.count_nonzero(table[:, i >> 6] & np.uint64(1 << (i & 63))) for i in range(len(languages))]) / slots
    return Filters(languages, table, np.minimum(fill**HASHES, 0.999))


def typical_grams(documents: DataFrame, sample: int = SAMPLE_DOCS, grams: int = GRAMS) -> dict[str, np.ndarray]:
    """Each language's trigrams, from text and lang of documents (rows with a null text or lang teach nothing); SAMPLE_DOCS bounds the
    rows of a language."""
    import pyarrow as pa

    known = documents.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    every = cut(known.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(F.count("*") / sample)).alias("every")))
    some = known.join(F.broadcast(every) if every.count() <= BROADCAST_LANGUAGES else every, "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("every")) == 0).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(trigrams(text))
            for name, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(total, "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("p"))
    most = share.groupBy("gram").agg(F.max("p").alias("most"))
    typical = share.join(most, "gram").where((F.col("p") >= TYPICAL * F.col("most")) & (F.col("n") >= LEAST_COUNT))
    from pyspark.sql import Window

    top = typical.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("p"), "gram"))).where(F.col("k") <= grams)
    rows = top.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # at most ``grams`` numbers for each language
    return {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in rows}


def fit(documents: DataFrame, sample: int = SAMPLE_DOCS, grams: int = GRAMS) -> Filters:
    """The filters of typical_grams()."""
    return build(typical_grams(documents, sample, grams))


def predict(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1: the language's share of the corrected counts) of whole texts.

    documents: doc_id, text; more columns are ignored. A null text, or one without letters, gives ``und`` and 0; so does any text
    if no language was learned. Ties go to the first language by name. Repeated rows and null ids keep their rows.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [filters.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Learn on the folds whose crc32(doc_id) mod 4 is not 2 and predict all: doc_id, held_out, lang_pred, score."""
    filters = fit(documents.where(bucket_of(F.col("doc_id"), 4) != 2))
    return predict(documents, filters).select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
