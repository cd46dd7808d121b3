"""Phrase collocations by hierarchical pair naming.

Words found at least ``least`` times in their language get a name, a 64-bit hash. The texts are read a second time as stretches of such
names, since a phrase that frequent holds no other word. Then a phrase of k words is named after the pair of phrases of k-1 words that
begin one word apart: names of adjacent phrases are hashed into a pair's name, which is the same wherever the pair stands, pairs are
counted over all stretches, and those found often enough are the next level. A level's table holds each pair's two parents, so the
counts of its beginnings come down the left parents and those of its ends down the right ones, and what subsumes it is found among its
children: a longer phrase that is as frequent implies one of one word more.

Which names go on to the next level is told by a set of BITS hashed bits, the same size for any corpus; a name that meets another's bit
is only counted for nothing, since every level is counted in full: by the names of all pairs, sent as packed steps between ascending
numbers. The parents of a frequent name come from one piece of the texts that has it, so each is handed on once, however many tasks meet it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from netfusion.llm.common import partitions, shared_dir, written

LONGEST, LEAST, MOST = 5, 100, 2000
BITS = 1 << 25
#: Names of one row of stretches, and pairs counted before they are handed on.
STRETCH, FLUSH = 1 << 16, 1 << 21
#: Bits of a pair's name without the last one, which is always set.
SLOT_BITS = 63
#: Bytes of text that are cut into words at once, a longer text alone.
CHUNK = 1 << 22
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lang_seed(lang: str) -> int:
    return xxh64_intdigest(lang.encode())


def word_name(word: bytes, seed: int) -> int:
    return xxh64_intdigest(word, seed) | 1


def named_words(texts: list[bytes], lang: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, their names, place of each word of the texts among them; -1 between pieces)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    joined = b"\n".join(texts).lower().translate(_BREAKS).replace(b"\n", b" \n ")
    words = pc.split_pattern(pa.array([joined], pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
    different = [w.encode() for w in words.dictionary.to_pylist()]
    seed = lang_seed(lang)
    names = np.array([word_name(w, seed) for w in different], np.uint64)
    kind = np.array([{b"": 2, b"\n": 1}.get(w, 0) for w in different], np.int8)
    at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = at[kind[at] < 2]  # between two spaces is no word
    return different, names, np.where(kind[at] == 1, -1, at)


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * _C1) ^ (right + (right >> np.uint64(31))) * _C2
    h = (h ^ (h >> np.uint64(29))) * _C1
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


def marked(names: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which names have their bit set; the name 0, a break, has none."""
    slot = (names >> np.uint64(1)) & np.uint64(8 * len(bits) - 1)
    return (names != 0) & ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def bits_of(names: DataFrame) -> np.ndarray:
    """A set of BITS bits for the names (column id): at most BITS/32 numbers come to the driver."""
    slots = names.select(F.shiftright("id", 1).bitwiseAND(F.lit(BITS - 1)).alias("slot"))
    rows = slots.groupBy(F.expr("CAST(shiftright(slot, 5) AS INT)").alias("at")).agg(F.expr("bit_or(shiftleft(1, CAST(slot % 32 AS INT)))").alias("v")).toArrow()
    bits = np.zeros(BITS // 32, np.int32)
    bits[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
    return bits.view(np.uint8)


def _texts(batch) -> Iterator[tuple[str, list[bytes]]]:
    """A batch's texts by language, some CHUNK bytes at a time."""
    import pyarrow as pa

    by: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        held, size = by.get(lang, ([], 0))
        held.append(text.as_py())
        by[lang] = held, size + len(held[-1])
        if by[lang][1] >= CHUNK:
            yield lang, by.pop(lang)[0]
    for lang, (held, _) in by.items():
        yield lang, held


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _texts(batch):
                words, _, at = named_words(texts, lang)
                n = np.bincount(at[at >= 0], minlength=len(words))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([words[i] for i in some.tolist()], pa.binary()).cast(pa.string()), pa.array(n[some])], names=["lang", "word", "n"]
                )

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def with_names(words: DataFrame) -> DataFrame:
    """id, lang, word, f: words with their names, which tasks would otherwise send along with each count."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([word_name(w.encode(), lang_seed(lang)) for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *batch.columns], names=["id", "lang", "word", "f"])

    return words.select("lang", "word", "f").mapInArrow(run, "id long, lang string, word string, f long")


def stretches(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """piece, names: the texts as names of frequent words, in rows of about STRETCH; a 0 stands wherever something else was. What one task
    writes is a piece."""
    import pyarrow as pa
    from pyspark import TaskContext

    wide = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _texts(batch):
                _, names, at = named_words(texts, lang)
                names = np.append(np.where(marked(names, wide.value), names, np.uint64(0)), np.uint64(0))[at]
                if not names.any():
                    continue
                alone = np.append(True, names[:-1] == 0) & np.append(names[1:] == 0, True)
                names[alone] = 0
                names = names[np.append(True, (names[1:] != 0) | (names[:-1] != 0))]
                breaks = np.flatnonzero(names == 0)
                # rows end at breaks, so that no pair is cut
                ends = np.unique(np.append(breaks[np.minimum(np.searchsorted(breaks, np.arange(STRETCH, len(names), STRETCH)), len(breaks) - 1)] if len(breaks) else breaks, len(names)))
                ends = ends[ends > 0]
                offsets = pa.array(np.append(0, ends), pa.int32())
                if names.any():
                    piece = pa.array(np.full(len(ends), TaskContext.get().partitionId(), np.int32))
                    yield pa.RecordBatch.from_arrays([piece, pa.ListArray.from_arrays(offsets, pa.array(names.view(np.int64)))], names=["piece", "names"])

    return docs.mapInArrow(run, "piece int, names array<long>")


def _adjacent(batches: Iterator, levels: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(piece, left, right): names of adjacent phrases of len(levels) words in rows of stretches, some FLUSH at a time. ``levels`` has the
    bits of shorter phrases, words first."""
    now, held, size = None, [], 0
    for batch in batches:
        for piece, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and (piece != now or size >= FLUSH):
                yield now, *(np.concatenate(c) for c in zip(*held, strict=True))
                held, size = [], 0
            now = piece
            x = row.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for bits in levels[1:]:
                both = (x[:-1] != 0) & (x[1:] != 0)
                x = np.where(both, pair_names(x[:-1], x[1:]), np.uint64(0))
                x[~marked(x, bits)] = 0
            both = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
            if len(both):
                held.append((x[both], x[both + 1]))
                size += len(both)
    if held:
        yield now, *(np.concatenate(c) for c in zip(*held, strict=True))


def packed(slots: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending slots of a bucket and their counts: byte planes of the steps between slots (7 bytes) and of the counts (4), which pack well."""
    steps = np.diff(slots, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    return steps.T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(11, -1).T
    steps = np.zeros((len(planes), 8), np.uint8)
    steps[:, :7] = planes[:, :7]
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64), np.ascontiguousarray(planes[:, 7:]).view("<u4")[:, 0].astype(np.int64)


def counted(slots: np.ndarray, n: np.ndarray, *turns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different slots, ascending, the sums of their counts and, if given, their greatest turns."""
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    new = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
    return slots[new], np.add.reduceat(n[order], new), *(np.maximum.reduceat(t[order], new) for t in turns)


def turns_of(slots: np.ndarray, piece: int) -> np.ndarray:
    """Numbers that end in the piece and are dealt anew for each slot, so that the greatest of a slot is each piece's equally often."""
    h = (slots + np.uint64((piece + 1) * int(_C2) & 0xFFFFFFFFFFFFFFFF)) * _C1
    return ((h ^ (h >> np.uint64(29))) * _C2 & ~np.uint64(0xFFFFFFFF)) | np.uint64(piece)


def frequent_slots(rows: DataFrame, levels: list[np.ndarray], least: int, slot_bits: int = SLOT_BITS) -> DataFrame:
    """id, f, piece: names that the pairs of len(levels) + 1 words take at least ``least`` times, and one piece that has such a pair.

    A task sends a bucket's names of each piece as one row of packed steps, and the receiver adds up one bucket at a time; a bucket, by
    ``slot_bits`` bits at most, holds a part of the names, whatever the words.
    """
    import pyarrow as pa

    p = partitions(rows.sparkSession)
    cut_bits = min(max(10, (8 * p - 1).bit_length()), slot_bits)
    shift = np.uint64(SLOT_BITS - cut_bits)
    wide = rows.sparkSession.sparkContext.broadcast(levels)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, left, right in _adjacent(batches, wide.value):
            slots, n = np.unique(pair_names(left, right) >> np.uint64(1), return_counts=True)
            buckets = (slots >> shift).astype(np.int32)
            at = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(slots))
            inside = slots & np.uint64((1 << int(shift)) - 1)
            data = [packed(inside[i:j], n[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets[at[:-1]]), pa.array(np.full(len(data), piece, np.int32)), pa.array(data, pa.binary())], names=["bucket", "piece", "slots"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total(held: list) -> tuple[np.ndarray, ...]:
            return counted(*(np.concatenate(c) for c in zip(*held, strict=True)))

        def often(bucket: int, held: list) -> pa.RecordBatch:
            slots, n, turns = total(held)
            slots, n, turns = slots[n >= least], n[n >= least], turns[n >= least]
            ids = (((np.uint64(bucket) << shift) | slots) << np.uint64(1)) | np.uint64(1)
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n), pa.array((turns & np.uint64(0xFFFFFFFF)).astype(np.int32))], names=["id", "f", "piece"])

        now, held, size = None, [], 0
        for batch in batches:
            for bucket, piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    if held:
                        yield often(now, held)
                    now, held, size = bucket, [], 0
                slots, n = unpacked(data.as_py())
                held.append((slots, n, turns_of(slots, piece)))
                size += len(slots)
                if size >= FLUSH:
                    held = [total(held)]
                    size = 0
        if held:
            yield often(now, held)

    dealt = rows.mapInArrow(send, "bucket int, piece int, slots binary").repartition(p, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "id long, f long, piece int")


def pairs(rows: DataFrame, levels: list[np.ndarray], least: int) -> DataFrame:
    """id, left, right, f of the frequent phrases of len(levels) + 1 words.

    Names are counted first. Frequent ones are then written by the piece whose turn it is, and a task that reads a piece looks for the names
    of that piece only and hands on their parents once; nothing goes through the driver, and no task holds names of other pieces.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/phrase-often-{uuid.uuid4().hex}"
    frequent_slots(rows, levels, least).repartition("piece").write.partitionBy("piece").parquet(path)
    wide = spark.sparkContext.broadcast(levels)

    def names_of(piece: int) -> np.ndarray:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        at = f"{root}/piece={piece}"
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return np.zeros(0, np.uint64)
        found = ds.dataset(at, format="parquet", filesystem=store).to_table(columns=["id"]).column("id").to_numpy()
        return np.sort(found.view(np.uint64))

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, np.zeros(0, np.uint64)
        for piece, left, right in _adjacent(batches, wide.value):
            if piece != now:
                now, mine = piece, names_of(piece)
            if not len(mine):
                continue
            names = pair_names(left, right)
            at = np.minimum(np.searchsorted(mine, names), len(mine) - 1)
            hit = np.flatnonzero(mine[at] == names)
            some, first = np.unique(at[hit], return_index=True)
            hit = hit[first]
            yield pa.RecordBatch.from_arrays([pa.array(c[hit].view(np.int64)) for c in (names, left, right)], names=["id", "left", "right"])
            mine = np.delete(mine, some)  # each once

    often = spark.read.schema("id long, f long, piece int").parquet(path).select("id", "f")
    # a piece may be read by several tasks
    return rows.mapInArrow(parents, "id long, left long, right long").dropDuplicates(["id"]).join(often, "id").select("id", "left", "right", "f")


def _with_parents(level: DataFrame, shorter: DataFrame) -> DataFrame:
    """A level's phrases with their words and the counts of their beginnings (starts) and ends, shortest first, from their parents' rows."""
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("starts").alias("_starts"))
    right = shorter.select(F.col("id").alias("right"), F.col("last"), F.col("ends").alias("_ends"))
    both = level.join(left, "left").join(right, "right")
    grown = lambda c: F.concat(c, F.array("f"))
    return both.select("id", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", grown("_starts").alias("starts"), grown("_ends").alias("ends"))


def _score(a: str, n: str, left: str, right: str) -> str:
    """1000*a*n / (l*r), floored; exact in 38 digits."""
    wide = lambda c, digits=19: f"CAST({c} AS DECIMAL({digits},0))"
    return f"({wide(1000, 4)} * {wide(a, 15)} * {wide(n)}) DIV ({wide(left)} * {wide(right)})"


def lowest_cut(a: str = "f", n: str = "n") -> Column:
    """(score, k, l, r) of the cut with the least score, the first on ties; starts[k] and ends[k] count the first and last k words."""
    cut_at = f"named_struct('score', {_score(a, n, 'element_at(starts, k)', 'element_at(ends, size(ends) - k)')}, 'k', k, 'l', element_at(starts, k), 'r', element_at(ends, size(ends) - k))"
    return F.expr(f"array_min(transform(sequence(1, size(starts) - 1), k -> {cut_at}))")


def collocations(documents: DataFrame, least: int = LEAST, most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    documents: text, lang; more columns are ignored. A null text is empty, a null lang is 'und', as is one of that name; rows are counted
    as often as they come. Pieces end at .,;:!? and line ends, words at spaces and tabs, A-Z are lower-cased. Ties go by a descending,
    then by the phrase's bytes; one in score between cuts to the first cut. Texts without a frequent pair and an empty table give no rows.
    A score over 2^63 can't be, as l and r are at least a; 1000*a*n must stay below 10^38.
    """
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = written(word_counts(docs), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(with_names(counts.where(F.col("f") >= least)), "phrase-words-frequent")
    one = F.array("f")
    levels = [words.select("id", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", one.alias("starts"), one.alias("ends"))]
    bits = [bits_of(words)]
    rows = written(stretches(docs, bits[0]), "phrase-stretches")
    while len(levels) < longest:
        level = written(_with_parents(pairs(rows, bits, least), levels[-1]), f"phrase-level{len(levels) + 1}")
        levels.append(level)
        bits.append(bits_of(level))
    kept = None
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        if longer is not None:
            child = longer.select(F.col("left").alias("id"), F.col("f").alias("g")).union(longer.select("right", "f")).groupBy("id").agg(F.max("g").alias("g"))
            level = level.join(child, "id", "left").where("g IS NULL OR g < f").drop("g")
        level = level.select("lang", "phrase", "f", "starts", "ends")
        kept = level if kept is None else kept.union(level)
    scored = kept.join(totals, "lang").withColumn("c", lowest_cut())
    best = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("f"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "c.l", "c.r", "n", "c.score")
