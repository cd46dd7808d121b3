"""Jaccard self-join of shingle sets over a token-group matrix.

Equal sets become one node. All shingles have one order: by how full their counter is in a fixed array of counters over the whole
corpus, in steps, then by hash, so rare ones come first. Two similar sets share a shingle among the first fifth of each (at 0.8), and
their first common one stands so early in both that the shingles before it fit into the difference allowed.

- Groups: sets whose first shingle is the same, of those that another set has in its first fifth too, where places and sizes leave
  the two possibly similar; groups of over PART sets are cut.
- Matrix: a row for each group, its columns first-fifth shingles (exact, spread by shingle) and all shingles (hashed to bits, one
  array for each set, united for a group). Groups that meet in a column of the first kind are candidates.
- Opening: a candidate pair of groups is opened only for those sets of one whose bits outside the other's union fit into the difference
  allowed; sets of opened groups are compared by their bits, which again bound the difference from below. What is left is verified
  on the shingles of the whole texts.

Three rounds keep large clusters from being compared in full. The first verifies a star for each group on its own; the second one witness
for each two of the clusters found, which joins what hangs together; the third everything left between clusters that are still apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netfusion.llm.common import cut, partitions, written
from netfusion.llm.components import connected_components, joined_components
from netfusion.llm.decontam import shingle_hashes
from netfusion.llm.documents import keyed, narrow

SHINGLE, PERCENT = 5, 80
COUNTERS, SLICES = 1 << 24, 256
PART = 256
#: Pairs of sets that are compared one by one.
FEW = 64
FLUSH = 1 << 20
#: Bytes of text that are cut into words at once, a longer text alone.
CHUNK = 1 << 22
LEAST_BITS, MOST_BITS = 64, 1 << 17
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
_POPS = 1 << 22


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its different shingles, ascending; one of fewer words is one shingle, one without words has none."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield from _sets(held)
            held, size = [], 0
    yield from _sets(held)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    joined = b" \n ".join([t.lower().translate(_SPACES) for t in texts])
    words = pc.split_pattern(pa.array([joined], pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
    different = words.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.array([xxh64_intdigest(w) for w in different], np.uint64)
    kind = np.array([{b"": 2, b"\n": 1}.get(w, 0) for w in different], np.int8)
    at = words.indices.to_numpy(zero_copy_only=False)
    at = at[kind[at] < 2]
    ends = np.append(np.flatnonzero(kind[at] == 1), len(at)).tolist()
    h, out, start = hashes[at], [], 0
    windows = shingle_hashes(h, SHINGLE)
    for end in ends:
        n = end - start
        if n >= SHINGLE:
            x = np.sort(windows[start : end - SHINGLE + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            out.append(shingle_hashes(h[start:end], n) if n else h[:0])
        start = end + 1
    return out if texts else []


def node_of(h: np.ndarray) -> int:
    """The name of a set: 64 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def bits_of(h: np.ndarray) -> bytes:
    """A set hashed to at least four bits for each shingle; halves of such an array laid on each other are the array of half the bits."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(h) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(h & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


class Group:
    """Sets of one group by the width of their bits."""

    def __init__(self, nodes: list[int], sizes: list[int], bits: list[bytes], labels: list[int]):
        self.nodes, self.sizes, self.labels = np.array(nodes, np.int64), np.array(sizes, np.int64), np.array(labels, np.int64)
        widths = np.array([len(b) // 8 for b in bits])
        self.by = {w: (at := np.flatnonzero(widths == w), np.frombuffer(b"".join(bits[i] for i in at.tolist()), np.uint64).reshape(-1, w)) for w in np.unique(widths).tolist()}

    def union(self) -> np.ndarray:
        least = min(self.by)
        return np.bitwise_or.reduce(np.vstack([folded(b, least) for _, b in self.by.values()]))[None, :]

    def within_reach(self, other: Group, percent: int) -> np.ndarray:
        """Which sets may have a similar one in the other group: what they have outside its union must fit into the difference."""
        union, most, ok = other.union(), int(other.sizes.max()), np.zeros(len(self.nodes), bool)
        for w, (at, bits) in self.by.items():
            width = min(w, union.shape[1])
            outside = np.bitwise_count(folded(bits, width) & ~folded(union, width)).sum(1, dtype=np.int64)
            ok[at] = fits(self.sizes[at] + most, outside, percent)
        return ok


def fits(total: np.ndarray | int, difference: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """If sets whose sizes sum to total and whose symmetric difference is given are similar: 100 * shared >= percent * united."""
    return (100 - percent) * total >= (100 + percent) * difference


def near_pairs(a: Group, b: Group, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the pairs with different labels that their bits leave possible; a pair once if b is a."""
    reach_a = a.within_reach(b, percent)
    if not reach_a.any() or not (reach_b := b.within_reach(a, percent)).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = []
    for wa, (at_a, bits_a) in a.by.items():
        keep = reach_a[at_a]
        at_a, bits_a = at_a[keep], bits_a[keep]
        for wb, (at_b, bits_b) in b.by.items():
            keep = reach_b[at_b]
            at, bits, width = at_b[keep], folded(bits_b[keep], min(wa, wb)), min(wa, wb)
            if not len(at) or not len(at_a):
                continue
            mine = folded(bits_a, width)
            step = max(1, _POPS // (len(at) * width))
            for i in range(0, len(at_a), step):
                gap = np.bitwise_count(mine[i : i + step, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int64)
                total = a.sizes[at_a[i : i + step], None] + b.sizes[at][None, :]
                gap = np.maximum(gap, np.abs(a.sizes[at_a[i : i + step], None] - b.sizes[at][None, :]))
                x, y = np.nonzero(fits(total, gap, percent) & (a.labels[at_a[i : i + step], None] != b.labels[at][None, :]))
                out.append((at_a[i + x], at[y]))
    x, y = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return (x[x < y], y[x < y]) if same else (x, y)


def folded_int(bits: int, width: int, to: int) -> int:
    """The same for an array held as one integer, from width bits to fewer."""
    while width > to:
        width //= 2
        bits = bits >> width | bits & (1 << width) - 1
    return bits


class Rows:
    """Lists of sets in one column of a batch."""

    def __init__(self, column):
        values = column.values
        self.offsets = column.offsets.to_pylist()
        self.node, self.n, self.label = (values.field(k).to_pylist() for k in ("node", "n", "label"))
        self.bits = values.field("bits").to_pylist()
        self.ints: dict[int, int] = {}

    def span(self, row: int) -> range:
        return range(self.offsets[row], self.offsets[row + 1])

    def group(self, row: int) -> Group:
        a, z = self.offsets[row], self.offsets[row + 1]
        return Group(self.node[a:z], self.n[a:z], self.bits[a:z], self.label[a:z])

    def int_of(self, k: int) -> int:
        if k not in self.ints:
            self.ints[k] = int.from_bytes(self.bits[k], "little")
        return self.ints[k]


def near_few(one: Rows, i: range, two: Rows, j: range, percent: int, same: bool) -> list[tuple[int, int, int, int]]:
    """near_pairs() of small groups, one by one: (x, y, label of x, label of y)."""
    out = []
    for k in i:
        for m in j:
            if one.label[k] == two.label[m] or same and k - i.start >= m - j.start:
                continue
            total = one.n[k] + two.n[m]
            if not fits(total, abs(one.n[k] - two.n[m]), percent):
                continue
            wide, other = 8 * len(one.bits[k]), 8 * len(two.bits[m])
            least = min(wide, other)
            if fits(total, (folded_int(one.int_of(k), wide, least) ^ folded_int(two.int_of(m), other, least)).bit_count(), percent):
                out.append((one.node[k], two.node[m], one.label[k], two.label[m]))
    return out


def stars(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """(hub, member): each of n positions with a pair goes to one hub."""
    near: dict[int, list[int]] = {}
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    taken, out = set(), []
    for hub in sorted(near, key=lambda k: (-len(near[k]), k)):
        if hub not in taken:
            taken.add(hub)
            mine = [k for k in near[hub] if k not in taken]
            taken.update(mine)
            out += [(hub, k) for k in mine]
    return out


# --- passes over the texts


def _digests(docs: DataFrame) -> DataFrame:
    """A row for each document (did, th, doc_id, n, node, bits) and, from each task, its counters in slices (slice, counts)."""
    import pyarrow as pa

    names = ["did", "th", "doc_id", "n", "node", "bits", "slice", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            sets = list(sets_of([t.as_py() for t in batch.column(3).cast(pa.binary())]))
            for h in sets:
                np.add.at(counts, (h & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
            none = [None] * len(sets)
            columns = [batch.column(0), batch.column(1), batch.column(2), [len(h) for h in sets], [node_of(h) if len(h) else None for h in sets], [bits_of(h) if len(h) else None for h in sets], none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if counts.any():
            none = [None] * SLICES
            packed = [packed_counts(c) for c in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([none] * 6 + [list(range(SLICES)), packed], kinds, strict=True)], names=names)

    return docs.select("did", "th", "doc_id", "text").mapInArrow(run, "did long, th long, doc_id long, n long, node long, bits binary, slice int, counts binary")


def packed_counts(counts: np.ndarray) -> bytes:
    """Counters of a slice: a bit for each that isn't 0, then the values of those."""
    used = counts[counts > 0]
    return zlib.compress(np.packbits(counts > 0).tobytes() + used.astype(np.uint8 if used.max(initial=0) < 256 else np.uint32).tobytes(), 1)


def add_counts(sums: np.ndarray, packed: bytes) -> None:
    """Add the counters of packed_counts() to sums."""
    data, n = zlib.decompress(packed), -(-len(sums) // 8)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, n), count=len(sums)))
    sums[at] += np.frombuffer(data, np.uint8 if len(data) - n == len(at) else np.uint32, offset=n)


def counter_steps(counters: DataFrame) -> np.ndarray:
    """How full each counter is, in steps of half a power of two. counters: slice, counts."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                add_counts(sums.setdefault(k, np.zeros(COUNTERS // SLICES, np.int64)), packed.as_py())
        steps = {k: (2 * np.log2(v + 1)).astype(np.uint8).tobytes() for k, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array([*steps], pa.int32()), pa.array([*steps.values()], pa.binary())], names=["slice", "steps"])

    spread = counters.repartition(min(SLICES, partitions(counters.sparkSession)), "slice").mapInArrow(run, "slice int, steps binary")
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for row in spread.collect():  # SLICES rows
        out[row["slice"]] = np.frombuffer(row["steps"], np.uint8)
    return out.ravel()


def ordered(h: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Ascending hashes in the order of the join."""
    return h[np.argsort(steps[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")]


def _columns(docs: DataFrame, steps: np.ndarray, percent: int) -> DataFrame:
    """(key, node, place, n): each set's first shingles with their places in its order and its size. Equal sets come once from a task, mostly."""
    import pyarrow as pa

    wide = docs.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, size = [], 0
            for h in sets_of([t.as_py() for t in batch.column(0).cast(pa.binary())]):
                if not len(h) or (node := node_of(h)) in seen:
                    continue
                if len(seen) >= FLUSH:
                    seen.clear()  # only equal sets far apart come again
                seen.add(node)
                held.append((node, len(h), ordered(h, wide.value)[: (100 - percent) * len(h) // 100 + 1]))
                size += len(held[-1][2])
                if size >= FLUSH:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    def rows(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(first) for _, _, first in held]
        columns = [
            pa.array(np.concatenate([first for _, _, first in held]).view(np.int64)), pa.array(np.repeat(np.array([node for node, _, _ in held], np.int64), sizes)),
            pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])), pa.array(np.repeat(np.array([n for _, n, _ in held], np.int32), sizes)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["key", "node", "place", "n"])

    return docs.select("text").mapInArrow(run, "key long, node long, place int, n int")


def _by_key(rows: DataFrame, solve: Callable[[np.ndarray], Iterator[np.ndarray]], schema: str) -> DataFrame:
    """solve() on rows (columns as longs, key first) that hold keys whole; tasks hold one key and some FLUSH rows at a time."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solved(some: np.ndarray) -> Iterator[pa.RecordBatch]:
            for out in solve(some):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k].copy()).cast(kind) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(map(len, held)) >= FLUSH:
                some = np.concatenate(held)
                whole = int(np.searchsorted(some[:, 0], some[-1, 0]))
                yield from solved(some[:whole])
                held = [some[whole:]]
        if held:
            yield from solved(np.concatenate(held))

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, schema)


def _shared(rows: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Of key, node, place, n those rows whose key another node has that may be similar by both places and sizes, each once.

    Keys of over FEW nodes aren't compared: of those all rows stay.
    """
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]]
    _, where, many = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
    keep = many[where] > FEW
    at, step = np.flatnonzero(~keep), 1
    while len(at := at[at + step < len(rows)]) and len(at := at[rows[at, 0] == rows[at + step, 0]]):
        x, y = rows[at], rows[at + step]
        ok = fits(x[:, 3] + y[:, 3], x[:, 2] + y[:, 2] + np.abs(x[:, 3] - x[:, 2] - y[:, 3] + y[:, 2]), percent)
        keep[at[ok]] = keep[at[ok] + step] = True
        step += 1
    yield rows[keep]


def _meetings(rows: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Of key, grp, slack, low, high, prev the different pairs of groups that share a key and may hold similar sets.

    prev is the shared key before this one in all sets of the group that have this one, else 0: groups with the same one meet there, or before.
    """

    def different(pairs: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(pairs)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        return both[np.append(True, (both[1:] != both[:-1]).any(1))]

    out, step, at = [], 1, np.arange(len(rows))
    while len(at := at[at + step < len(rows)]) and len(at := at[rows[at, 0] == rows[at + step, 0]]):
        x, y = rows[at], rows[at + step]
        ok = (x[:, 2] + y[:, 2] <= 0) & ((x[:, 5] != y[:, 5]) | (x[:, 5] == 0)) & (100 * x[:, 4] >= percent * y[:, 3]) & (100 * y[:, 4] >= percent * x[:, 3])
        if ok.any():
            out.append(np.sort(np.column_stack([x[ok, 1], y[ok, 1]]), axis=1))
        step += 1
        if out and sum(map(len, out)) > FLUSH:
            yield different(out)
            out = []
    if out:
        yield different(out)


# --- opening groups and verifying


def _groups(sets: DataFrame) -> DataFrame:
    """grp, part, sets: the sets (node, n, bits, label) of each part of a group."""
    return sets.groupBy("grp", "part").agg(F.collect_list(F.struct("node", "n", "bits", "label")).alias("sets"))


def _stars(groups: DataFrame, percent: int) -> DataFrame:
    """(x, y): for each part of a group, sets that may be similar to a hub of it."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], Rows(batch.column(0))
            for row in range(batch.num_rows):
                g = rows.group(row)
                out += [(g.nodes[a], g.nodes[b]) for a, b in stars(len(g.nodes), *near_pairs(g, g, percent, True))]
            x, y = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return groups.where(F.size("sets") > 1).select("sets").mapInArrow(run, "x long, y long")


def _opened(pairs: DataFrame, groups: DataFrame, percent: int, witnesses: bool) -> DataFrame:
    """Pairs of sets (x, y of clusters lx, ly) in pairs of parts (a, i, b, j) that bits leave possible: one for each two clusters with
    their number, or all."""
    import pyarrow as pa

    left = groups.select(F.col("grp").alias("a"), F.col("part").alias("i"), F.col("sets").alias("one"))
    right = groups.select(F.col("grp").alias("b"), F.col("part").alias("j"), F.col("sets").alias("two"))
    both = pairs.select("a", "i", "b", "j").join(left, ["a", "i"]).join(right, ["b", "j"])
    names = ["a", "i", "b", "j", "x", "y", "lx", "ly", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, one, two = [c.to_pylist() for c in batch.columns[:4]], Rows(batch.column(4)), Rows(batch.column(5))
            for row, (a, i, b, j) in enumerate(zip(*ids, strict=True)):
                mine, others, same = one.span(row), two.span(row), (a, i) == (b, j)
                if len({*one.label[mine.start : mine.stop], *two.label[others.start : others.stop]}) == 1:
                    continue
                if len(mine) * len(others) <= FEW:
                    found = near_few(one, mine, two, others, percent, same)
                else:
                    g, h = one.group(row), two.group(row)
                    x, y = near_pairs(g, h, percent, same)
                    found = zip(g.nodes[x].tolist(), h.nodes[y].tolist(), g.labels[x].tolist(), h.labels[y].tolist(), strict=True)
                found = sorted((lx, ly, x, y) if lx < ly else (ly, lx, y, x) for x, y, lx, ly in found)
                if witnesses:
                    for (lx, ly), same_two in groupby(found, key=lambda f: f[:2]):
                        some = list(same_two)
                        out.append((a, i, b, j, some[0][2], some[0][3], lx, ly, len(some)))
                else:
                    out += [(a, i, b, j, x, y, lx, ly, 1) for lx, ly, x, y in found]
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return both.select("a", "i", "b", "j", "one", "two").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y) those whose sets are similar, by the shingles of their whole texts: a, b.

    A hub's text meets those of PART others at most in one place. nodes: node, did, th."""
    import pyarrow as pa

    pairs = pairs.distinct()
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    asked = written(pairs.join(parts, "x").select("x", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"), "y"), "jaccard-asked")
    wanted = asked.select("x", "part", F.col("y").alias("node")).union(asked.select("x", "part", F.col("x").alias("node")).distinct())
    wanted = wanted.join(nodes.select("node", "did", "th"), "node")
    near, _ = narrow(docs.select("did", "th", "text"), wanted, "did", "th")
    texts = near.dropDuplicates(["did", "th"]).join(wanted, ["did", "th"]).select("x", "part", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            out = []
            x, part, node = (batch.column(k).to_pylist() for k in range(3))
            for k, h in enumerate(sets_of([t.as_py() for t in batch.column(3).cast(pa.binary())])):
                if (x[k], part[k]) != at:
                    at, hub = (x[k], part[k]), h  # a place begins with its hub
                    continue
                shared = len(hub) + len(h) - len(np.union1d(hub, h))
                if fits(len(hub) + len(h), len(hub) + len(h) - 2 * shared, percent):
                    out.append((x[k], node[k]))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = texts.repartition(partitions(docs.sparkSession), "x", "part").sortWithinPartitions("x", "part", F.col("x") != F.col("node"))
    return dealt.select("x", "part", "node", "text").mapInArrow(run, "a long, b long")


def similar_documents(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (size of the document's set) and component_id (the least doc_id that chains of links reach) of each document.

    documents: doc_id, text; more columns are ignored. Sets are of five-word shingles of the text with A-Z lower-cased; with fewer words the
    whole sequence is the one shingle. Two documents link if 100 * shared >= percent * united, equality included. A text that is null, empty
    or without words has no shingles and is linked with nothing. Repeated rows stay and are linked with each other; a null doc_id keeps
    its row and never names a component with other ids. An empty table gives none. Shingles are told apart by 64-bit hashes, sets by
    64 bits of a digest.
    """
    docs = keyed(documents)
    seen = written(_digests(docs), "jaccard-digests")
    rows, counters = seen.where("slice IS NULL"), seen.where("slice IS NOT NULL").select("slice", "counts")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least_doc"), F.min_by(F.struct("did", "th", "n", "bits"), F.struct("did", "th")).alias("r"))
    nodes = written(nodes.select("node", "least_doc", "r.*"), "jaccard-nodes")
    steps = counter_steps(counters)
    shared = _by_key(_columns(docs, steps, percent), lambda rows: _shared(rows, percent), "key long, node long, place int, n int")
    own = Window.partitionBy("node").orderBy("place")
    shared = written(shared.withColumns({"grp": F.first("key").over(own), "prev": F.lag("key").over(own)}), "jaccard-shared")
    sets = shared.where("prev IS NULL").select("node", "grp")
    slack = (100 + percent) * F.col("place").cast("long") - (100 - percent) * F.col("n")
    prev = F.when((F.count("prev") == F.count("*")) & (F.min("prev") == F.max("prev")), F.min("prev"))
    matrix = shared.groupBy("key", "grp").agg(F.min(slack).alias("slack"), F.min("n").cast("long").alias("low"), F.max("n").cast("long").alias("high"), F.coalesce(prev, F.lit(0)).alias("prev"))
    apart = _by_key(matrix, lambda rows: _meetings(rows, percent), "a long, b long").distinct()
    sizes = written(sets.groupBy("grp").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n_sets")), "jaccard-groups")
    apart = written(apart, "jaccard-pairs")
    open_ = apart.select(F.col("a").alias("grp")).union(apart.select("b")).union(sizes.where("n_sets > 1").select("grp")).distinct()
    sets = sets.join(open_, "grp", "left_semi").join(sizes.drop("n_sets"), "grp").join(nodes.select("node", "n", "bits"), "node")
    sets = written(sets.select("grp", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "n", "bits", F.col("node").alias("label")), "jaccard-sets")
    # one: stars inside the parts of groups; a set is in one star at most, so its hub is the label
    links = cut(verified(docs, nodes, _stars(_groups(sets), percent), percent))
    hubs = links.select(F.col("b").alias("node"), F.col("a").alias("_hub"))
    sets = written(sets.drop("label").join(hubs, "node", "left").withColumn("label", F.coalesce("_hub", "node")).drop("_hub"), "jaccard-labels")
    # two: a witness for each two clusters, over all pairs of parts that may hold one
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    end = lambda c: sizes.select(F.col("grp").alias(c), F.col("parts").alias(f"p{c}"))
    cross = apart.join(end("a"), "a").join(end("b"), "b").select("a", upto("pa").alias("i"), "b", "pb").select("a", "i", "b", upto("pb").alias("j"))
    alone = sizes.where("n_sets > 1").select(F.col("grp").alias("a"), upto("parts").alias("i"), F.col("grp").alias("b"), "parts").select("a", "i", "b", upto("parts").alias("j")).where("i <= j")
    left = written(_opened(cross.unionByName(alone), _groups(sets), percent, True), "jaccard-open")
    chosen = written(left.groupBy("lx", "ly").agg(F.min(F.struct("x", "y")).alias("w")).select("lx", "ly", "w.*"), "jaccard-witnesses")
    found = cut(verified(docs, nodes, chosen.select("x", "y"), percent))
    links = links.union(found)
    # three: all pairs of the clusters that are still apart, where they aren't verified already
    joined = chosen.join(found.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi").select("lx", "ly")
    left = left.join(chosen.select("x", "y", F.lit(True).alias("done")), ["x", "y"], "left").where("done IS NULL OR n > 1").join(joined, ["lx", "ly"], "left_anti")
    left = written(left, "jaccard-left")
    roots = connected_components(links)
    if not left.isEmpty():
        side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        left = left.join(side("x"), "x", "left").join(side("y"), "y", "left").where("coalesce(rx, x) <> coalesce(ry, y)").select("a", "i", "b", "j").distinct()
        labelled = sets.drop("label").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
        found = cut(verified(docs, nodes, _opened(left, _groups(labelled), percent, False).select("x", "y"), percent))
        roots = joined_components(roots, found)
    named = nodes.select("node", "least_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = written(named.join(heads, "root").select("node", "component_id"), "jaccard-named")
    out = rows.where("node IS NOT NULL").join(named, "node").select("doc_id", "n", "component_id").union(rows.where("node IS NULL").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
