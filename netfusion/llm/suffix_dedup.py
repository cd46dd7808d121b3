"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are sorted through the first 400 bytes only, most significant digit first; a suffix alone in its group leaves, and the groups
left after the last pass are exactly the repeated windows. To keep that affordable the first digit is not read at every suffix: a
window's digit is the 64-byte string in it with the least hash (the leftmost of equals), which equal windows share at the same place, so
neighbouring windows share it too and form a run. Three kinds of passes follow:

1. Runs are grouped by that string. A string found once has no repeats: nearly all of the corpus leaves here, at about one row in 170 bytes.
2. Runs of a group are grouped by all the bytes they span. Where two or more are equal, all their windows are repeated.
3. Of each such class one run goes on, with its bytes; its windows are sorted by offset, then by 64 bytes at a time to the 400th.

What equal means in each pass: runs are equal if the 128-bit BLAKE2 digests of their bytes are. Digits are compared by 64-bit hashes (so the
passes group suffixes, they don't order them), and the windows that they leave together are compared byte by byte. Large groups are cut
into parts whose windows meet again in a second shuffle by two independent hashes of their bytes, of 64 bits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfusion.llm.common import partitions, written
from netfusion.llm.documents import keyed, narrow

WINDOW, GRAM = 400, 64
CHUNK = 1 << 18
PART_RUNS = 4096
_PLACE = np.uint64((1 << 24) - 1)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(400).integers(0, 2**63, 256, dtype=np.uint64)
#: For hashes that owe nothing to the first ones: bytes and multipliers of their own.
_BYTES2 = np.random.default_rng(401).integers(0, 2**63, 256, dtype=np.uint64)
_D1, _D2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a power of two) at each position that has them."""
    return _folded(_BYTES[data], size, _C1, _C2)


def second_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The same, independent of gram_hashes()."""
    return _folded(_BYTES2[data], size, _D1, _D2)


def _folded(h: np.ndarray, size: int, c1: np.uint64, c2: np.uint64) -> np.ndarray:
    m = 1
    while m < size:
        h = h[:-m] * c1 + (h[m:] ^ (h[m:] >> np.uint64(32))) * c2 if len(h) > m else h[:0]
        h ^= h >> np.uint64(29)
        m *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def runs(data: bytes, window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """(first window, last window, place of the least string in the first one, its hash) of each run of a text's windows."""
    raw = np.frombuffer(data, np.uint8)
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(raw) - window + 1, chunk):
        h = gram_hashes(raw[at : at + chunk + window - 1], gram)
        places = np.arange(len(h), dtype=np.uint64)
        least = (sliding_min((h & ~_PLACE) | places, window - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        anchor = least[first]
        out.append((first + at, last + at, anchor - first, h[anchor]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _differ(raw: np.ndarray, at: np.ndarray, other: np.ndarray, window: int) -> bool:
    """If some window of raw at ``at`` (ascending) isn't the one at ``other``. Neighbours that have neighbours as partners share a comparison."""
    if not len(at):
        return False
    new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(other) != 1)))
    for a, z in zip(new.tolist(), np.append(new[1:], len(at)).tolist(), strict=True):
        n = z - a - 1 + window
        if not np.array_equal(raw[at[a] : at[a] + n], raw[other[a] : other[a] + n]):
            return True
    return False


def repeated_windows(contexts: list[bytes], offsets: list[int], window: int = WINDOW, digests: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs that share their least string at ``offsets``: (context, window in it, if it is repeated here, two digests) of all windows.

    The digests are of the windows' bytes by two independent hashes; the second is made only if ``digests`` is set.
    """
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) - window + 1 for c in contexts])
    context = np.repeat(np.arange(len(contexts)), sizes)
    inside = np.arange(len(context)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.cumsum([0, *map(len, contexts[:-1])])
    at = starts[context] + inside
    sizes_, left, size = [], window, GRAM
    while left:
        while size > left:
            size //= 2
        sizes_.append(size)
        left -= size
    depths = np.cumsum([0, *sizes_[:-1]]).tolist()
    group = (np.array(offsets)[context] - inside).astype(np.uint64)  # windows are equal only at equal offsets

    def digest_of(kind: Callable[[np.ndarray, int], np.ndarray]) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
        hashes = {n: kind(raw, n) for n in {*sizes_}}
        digits, digest = [(hashes[n], d) for n, d in zip(sizes_, depths, strict=True)], group.copy()
        for h, d in digits:
            digest = (digest ^ h[at + d]) * _C1
            digest ^= digest >> np.uint64(31)
        return digits, digest

    digits, digest = digest_of(gram_hashes)
    second = digest_of(second_hashes)[1] if digests else digest
    alive = np.arange(len(at))
    for h, d in [(None, 0), *digits]:
        if not len(alive):
            break
        key = group if h is None else group * _C2 + h[at[alive] + d]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        alive, group = alive[order[many]], number[many].astype(np.uint64)
    repeated = np.zeros(len(at), bool)
    repeated[alive] = True
    # the windows of a group byte by byte against its first one
    first = np.full(int(group.max()) + 1 if len(group) else 0, len(at))
    np.minimum.at(first, group.astype(np.int64), alive)
    own = np.sort(alive)
    partner = np.empty(len(at), np.int64)
    partner[alive] = first[group.astype(np.int64)]
    own = own[partner[own] != own]
    if _differ(raw, at[own], at[partner[own]], window):  # hashes agreed on different bytes: count the bytes themselves
        counts: dict[bytes, int] = {}
        for i in alive.tolist():
            w = raw[at[i] : at[i] + window].tobytes()
            counts[w] = counts.get(w, 0) + 1
        for i in alive.tolist():
            repeated[i] = counts[raw[at[i] : at[i] + window].tobytes()] > 1
    return context, inside, repeated, digest, second


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by [start, end) spans."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _run_rows(docs: DataFrame, window: int) -> DataFrame:
    import pyarrow as pa
    names = ["did", "th", "lo", "hi", "off", "key", "ctx", "ctx2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                data = text.as_py()
                if len(data) >= window:
                    lo, hi, off, key = runs(data, window)
                    view = memoryview(data)
                    # the place of the least string is part of the digest
                    ctx = b"".join(hashlib.blake2b(view[a : z + window], digest_size=16, salt=o.to_bytes(4, "little")).digest() for a, z, o in zip(lo.tolist(), hi.tolist(), off.tolist(), strict=True))
                    ctx = np.frombuffer(ctx, np.int64).reshape(-1, 2)
                    out.append((np.full(len(lo), did), np.full(len(lo), th), lo.astype(np.int32), hi.astype(np.int32), off.astype(np.int32), key.view(np.int64), ctx[:, 0], ctx[:, 1]))
                if sum(len(o[0]) for o in out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return docs.select("did", "th", "text").mapInArrow(run, "did long, th long, lo int, hi int, off int, key long, ctx long, ctx2 long")


def _contexts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of runs (did, th, lo, hi and more columns) as column data."""
    import pyarrow as pa

    more = [f for f in wanted.schema.fields if f.name not in ("did", "th")]
    lists = wanted.groupBy("did", "th").agg(F.collect_list(F.struct(*(f.name for f in more))).alias("runs"))
    near, _ = narrow(docs.select("did", "th", "text"), wanted, "did", "th")
    near = near.dropDuplicates(["did", "th"]).join(lists, ["did", "th"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                did, th, data, own = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py().encode(), batch.column(3)[k].as_py()
                rows = [{"did": did, "th": th, **r, "data": data[r["lo"] : r["hi"] + window]} for r in own]
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(more, pa))

    return near.select("did", "th", "text", "runs").mapInArrow(run, f"did long, th long, {schema}, data binary")


def _arrow(fields: list, pa) -> object:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([("did", pa.int64()), ("th", pa.int64()), *((f.name, kinds[f.dataType.simpleString()]) for f in fields), ("data", pa.binary())])


def _window_marks(contexts: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Of contexts (key, part, parts, single, off, ...): marks of repeated windows of single runs, and the windows of keys in several
    parts, one row for each different window of a part (did, th, lo of one that is single there, else null)."""
    import pyarrow as pa

    names = ["did", "th", "lo", "hi", "key", "wh", "wh2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def solve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            context, inside, repeated, digest, second = repeated_windows([r["data"] for r in rows], [r["off"] for r in rows], window, rows[0]["parts"] > 1)
            single = np.array([r["single"] for r in rows])[context]
            at = np.flatnonzero(repeated & single)
            spans = np.split(at, np.flatnonzero((np.diff(at) != 1) | (np.diff(context[at]) != 0)) + 1) if len(at) else []
            out = []
            for s in spans:
                r = rows[context[s[0]]]
                out.append((r["did"], r["th"], r["lo"] + int(inside[s[0]]), r["lo"] + int(inside[s[-1]]) + window, None, None, None))
            if rows[0]["parts"] > 1:
                order = np.lexsort((second, digest))
                new = np.flatnonzero(np.append(True, (np.diff(digest[order]) != 0) | (np.diff(second[order]) != 0)))
                index, counts = order[new], np.diff(np.append(new, len(order)))
                values = zip(digest[index].view(np.int64).tolist(), second[index].view(np.int64).tolist(), strict=True)
                for (wh, wh2), i, n in zip(values, index.tolist(), counts.tolist(), strict=True):
                    r = rows[context[i]]
                    lone = n == 1 and r["single"]
                    lo = r["lo"] + int(inside[i])
                    out.append((r["did"] if lone else None, r["th"] if lone else None, lo if lone else None, lo + window if lone else None, r["key"], wh, wh2))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["key"], r["part"]) != (held[0]["key"], held[0]["part"]):
                    yield from solve(held)
                    held = []
                held.append(r)
        if held:
            yield from solve(held)

    dealt = contexts.repartition(partitions(contexts.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    found = written(dealt.mapInArrow(run, "did long, th long, lo int, hi int, key long, wh long, wh2 long"), "suffix-windows")
    return found.where("wh IS NULL").select("did", "th", "lo", "hi"), found.where("wh IS NOT NULL")


def repeated_spans(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """did, th, spans: for each document (see keyed()) with repeated windows, the [lo, hi) byte ranges that they cover, unmerged."""
    docs = keyed(documents)
    all_runs = written(_run_rows(docs, window), "suffix-runs")
    # pass 1: strings found once leave
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("ctx", "ctx2") for f in (F.min, F.max)]
    keys = all_runs.groupBy("key").agg(F.count("*").alias("n"), *ends).where("n > 1")
    keys = written(keys.select("key", F.expr("min_ctx = max_ctx AND min_ctx2 = max_ctx2").alias("alike")), "suffix-keys")  # so that the join can split large keys
    left = written(all_runs.join(keys, "key"), "suffix-left")
    mark = lambda df: df.select("did", "th", "lo", (F.col("hi") + window).cast("int").alias("hi"))
    # pass 2: classes of equal runs
    mixed = left.where("NOT alike").drop("alike")
    classes = mixed.groupBy("key", "ctx", "ctx2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("did", "th", "lo", "hi", "off")))
    classes = written(classes, "suffix-classes")
    several = classes.where("n > 1").select("key", "ctx", "ctx2")
    # pass 3: one run of each class
    parts = classes.groupBy("key").agg(F.ceil(F.count("*") / PART_RUNS).cast("int").alias("parts"))
    residual = classes.join(written(parts, "suffix-parts"), "key").select("did", "th", "lo", "hi", "off", "key", "parts", (F.col("n") == 1).alias("single"))
    residual = residual.withColumn("part", F.pmod(F.xxhash64("did", "th", "lo"), F.col("parts")).cast("int"))
    near, split = _window_marks(_contexts(docs, residual, window), window)
    met = split.groupBy("key", "wh", "wh2").agg(F.count("*").alias("n"), F.collect_list(F.struct("did", "th", "lo", "hi")).alias("at")).where("n > 1")
    again = met.select(F.explode("at").alias("m")).select("m.*").where("did IS NOT NULL")
    marks = mark(left.where("alike")).union(mark(mixed.join(several, ["key", "ctx", "ctx2"], "left_semi"))).union(near).union(again)
    return marks.groupBy("did", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the bytes that stay).

    Each byte that a ``window``-byte string covers which also starts elsewhere, in any document or the same one, goes; strings
    are judged on the input. documents: doc_id, text; more columns are ignored. A null text is empty; a text shorter than the
    window loses nothing; rows repeated with id and text are documents of their own, so they lose all that a window covers. A null
    doc_id keeps its row. An empty table gives none. Kept bytes need not be valid UTF-8, as strings are cut at bytes.
    """
    import pyarrow as pa

    spans = written(repeated_spans(documents, window), "suffix-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                data, cut = text.as_py(), merge([(s["lo"], s["hi"]) for s in own.as_py() or ()])
                edges = [0, *(x for span in cut for x in span), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    near, rest = narrow(keyed(documents), spans, "did", "th")
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans")
    whole = near.join(spans, ["did", "th"], "left").select("doc_id", "text", "spans").union(rest.select("doc_id", "text", none))
    return whole.mapInArrow(run, RESULT)
