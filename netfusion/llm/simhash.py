"""SimHash near-duplicates over a Gray-order hierarchical index.

Distinct fingerprints are dealt into buckets such that any two within the distance meet in one (they agree on enough of the
blocks that the bits are cut into). A bucket's fingerprints are sorted by Gray rank, where neighbours share long runs of bits; each
group of neighbours becomes a node that holds the mask and pattern of the bits its members share. Pairs of nodes are compared
from the top: shared bits that differ already tell that no member can be near (the pair goes), and few free bits that all
are (one link joins both groups); only what is left is opened. Pairs whose members are already joined go too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfusion.llm.common import partitions, written
from netfusion.llm.components import connected_components

BITS, SHINGLE, DISTANCE, SEED = 64, 4, 4, 42
FANOUT = 16
BUCKET_MEAN = 4096
BUCKET_MOST = 8192
PAIRS = 1 << 19
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: bit i is 1 if over half the shingles' XXH64 have it; words are lower-cased for A-Z only."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space alone
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = np.array([xxh64_intdigest(joined[a:z], SEED) for a, z in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of whole texts; null texts are empty."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(x.as_py() or b"") for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def blocks(parts: int) -> list[int]:
    """Masks that cut 64 bits into ``parts`` blocks."""
    edges = [round(i * BITS / parts) for i in range(parts + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_masks(n: int, distance: int, mean: int = BUCKET_MEAN) -> list[int]:
    """Masks of kept bits, one for each way to lose ``distance`` blocks; more blocks as n grows, so that even buckets stay small."""
    for parts in range(distance + 1, BITS + 1):
        cut_up = blocks(parts)
        kept = [sum(c) for c in combinations(cut_up, parts - distance)]
        if n >> min(m.bit_count() for m in kept) <= mean or parts == distance + 5:
            return kept
    raise AssertionError


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Groups:
    """Union-find by whole arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            parent = np.arange(len(label))
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            label = parent[label]
        self.label = label


def index_levels(codes: np.ndarray, fanout: int = FANOUT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first code's position, mask, pattern) of the nodes of each level, codes themselves first."""
    levels = [(np.arange(len(codes)), np.full(len(codes), ~np.uint64(0)), codes)]
    while len(levels[-1][0]) > fanout:
        first, mask, pattern = levels[-1]
        at = np.arange(0, len(first), fanout)
        head = np.repeat(pattern[at], np.diff(np.append(at, len(first))))
        shared = np.bitwise_and.reduceat(mask & ~(pattern ^ head), at)
        levels.append((first[at], shared, pattern[at] & shared))
    return levels


def near_groups(codes: np.ndarray, distance: int = DISTANCE, fanout: int = FANOUT) -> np.ndarray:
    """For distinct codes: labels equal for those that chains of links join. Work falls with what nodes prune, not with pairs."""
    if len(codes) == 2:
        return np.zeros(2, np.int64) if int(np.bitwise_count(codes[0] ^ codes[1])) <= distance else np.arange(2)
    order = np.argsort(gray_rank(codes), kind="stable")
    codes = codes[order]
    n, groups, levels = len(codes), Groups(len(codes)), index_levels(codes[:], fanout)
    i, j = np.triu_indices(len(levels[-1][0]))
    near_first = np.argsort(j - i, kind="stable")
    stack = [(len(levels) - 1, i[near_first], j[near_first])]
    spans = [np.append(first, n) for first, _, _ in levels]
    while stack:
        level, a, b = stack.pop()
        if len(a) > (most := max(1, PAIRS // fanout**2 if level else PAIRS)):
            stack.append((level, a[most:], b[most:]))
            a, b = a[:most], b[:most]
        _, mask, pattern = levels[level]
        both = mask[a] & mask[b]
        least = np.bitwise_count((pattern[a] ^ pattern[b]) & both)
        if level == 0:
            near = least <= distance
            groups.join(a[near], b[near])
            continue
        span = spans[level]
        low, high = np.minimum.reduceat(groups.label, span[:-1]), np.maximum.reduceat(groups.label, span[:-1])
        joined = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        open_ = (least <= distance) & ~joined
        whole = open_ & (least + np.bitwise_count(~both) <= distance)
        for x, y in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
            members = np.concatenate([np.arange(span[x], span[x + 1]), np.arange(span[y], span[y + 1])])
            groups.join(members[:-1], members[1:])
        a, b = a[open_ & ~whole], b[open_ & ~whole]
        if not len(a):
            continue
        below = len(levels[level - 1][0])
        i, j = np.divmod(np.arange(fanout**2), fanout)
        i, j = (a[:, None] * fanout + i).ravel(), (b[:, None] * fanout + j).ravel()
        fit = (i < below) & (j < below) & (i < j if level == 1 else i <= j)
        i, j = i[fit], j[fit]
        near_first = np.argsort(j - i, kind="stable")
        stack.append((level - 1, i[near_first], j[near_first]))
    label = np.empty(n, np.int64)
    label[order] = groups.label
    return label


def links(codes: DataFrame, distance: int = DISTANCE, mean: int = BUCKET_MEAN, most: int = BUCKET_MOST) -> DataFrame:
    """Edges (a, b) that span the groups which links of at most ``distance`` bits form among the distinct ``fp`` of codes.

    A bucket of over ``most`` fingerprints is cut into parts, and each two parts meet in a task of their own; none is dropped.
    """
    import pyarrow as pa

    masks = bucket_masks(codes.count(), distance, mean)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for t, m in enumerate(masks)])
    rows = codes.select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.t").alias("t"), F.col("k.v").alias("v"))
    large = rows.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > most).select("t", "v", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    rows = rows.join(large, ["t", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, mine).alias("i"), F.greatest(p, mine).alias("j")))
    dealt = rows.select("fp", "t", "v", F.explode(meets).alias("m")).select(F.xxhash64("t", "v", "m.i", "m.j").alias("bucket"), "fp", "t", "v", F.col("m.i").alias("i"), F.col("m.j").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """rows: columns fp, t, v, i, j, whole buckets."""
            starts = np.flatnonzero(np.append(True, (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)))
            out_a, out_b = [], []
            for s, z in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                if z - s > 1:
                    fp = rows[s:z, 0]
                    label = near_groups(fp.view(np.uint64), distance)
                    moved = np.flatnonzero(label != np.arange(len(fp)))
                    if len(moved):
                        order = np.argsort(label, kind="stable")
                        same = label[order][1:] == label[order][:-1]
                        out_a.append(fp[order[:-1][same]])
                        out_b.append(fp[order[1:][same]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(map(len, held)) >= 1 << 16:
                rows = np.concatenate(held)
                last = len(rows) - 1
                change = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))
                last = int(change[-1]) + 1 if len(change) else 0
                yield from edges(rows[:last]) if last else ()
                held = [rows[last:]]
        if held and sum(map(len, held)):
            yield from edges(np.concatenate(held))

    tasks = dealt.repartition(partitions(codes.sparkSession), "bucket").sortWithinPartitions("t", "v", "i", "j", "fp")
    return tasks.select("fp", "t", "v", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that chains of links reach) of each document.

    documents: doc_id, text; more columns are ignored. Texts without words (null ones too) have fingerprint zero and are linked like
    any other. A null doc_id keeps its row and never names a component with other ids; repeated rows stay. An empty table gives none.
    """
    prints = written(fingerprints(documents), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "simhash-distinct")
    root = connected_components(links(distinct.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    members = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = members.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = members.join(heads, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents that head a component, with all their columns.

    Rows that share a doc_id stay if one of them heads its component; those equal in doc_id and text become one row. Rows without
    a doc_id can't be told apart and stay.
    """
    found = near_duplicates(documents, distance).where("doc_id IS NOT NULL")
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("_heads")).where("NOT _heads").select("doc_id")
    kept = documents.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return kept.select(documents.columns).unionByName(documents.where("doc_id IS NULL"))
