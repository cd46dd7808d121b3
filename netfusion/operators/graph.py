"""Graph operators over edge lists. edges: src, dst (and kind, confidence, day where an operator says so); nodes: id and attributes.

Iterative operators join and aggregate per round and end a round in a checkpoint. All-pairs kernels (betweenness, efficiency) read the
adjacency from the shared folder, behind a limit on its edges, and run breadth-first searches, spread over the cluster, 64 sources at a time
for betweenness and 512 for efficiency. Beyond the limit both take rounds over blocks of the adjacency, from all sources too.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfusion.operators.ranking import ranked
from netfusion.session import cut, shared_dir, stored

#: Edges beyond which betweenness takes SOURCES nodes as sources; None: it takes all nodes at any size, as every query does.
MAX_BROADCAST_EDGES = None
#: Edges up to which a task reads the adjacency, 8 bytes an edge.
MAX_SEARCHED_EDGES = 1 << 26
#: Sources of one search of efficiency, 64 to a word, and arcs that it looks at at a time.
SEARCH_WORDS, SEARCH_ARCS = 8, 1 << 22
#: Sources of a sampled betweenness.
SOURCES = 256
#: Sources of one search of betweenness, fewer where its state would have more numbers than SEARCH_STATE; arcs that are added up in a row.
SEARCH_SOURCES, SEARCH_STATE, RUN = 64, 1 << 23, 64
#: Pairs of source and node of a batch of rounds; sources of a slice, a number for each in a node's row; nodes of its blocks, as a power of two.
BATCH_ROWS, SLICE, SLICE_BITS = 1 << 25, 64, 13
#: Nodes of a block of the adjacency, as a power of two.
BLOCK_BITS = 12


def undirected(edges: DataFrame) -> DataFrame:
    """a < b: the simple graph under a multigraph, without loops."""
    return edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(simple: DataFrame) -> DataFrame:
    """u, v for each direction of a, b."""
    return simple.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def resolve_ends(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """src and dst replaced by their canonical ids where mentions (mention, canonical) has them."""
    m = lambda end: mentions.select(F.col("mention").alias(end), F.col("canonical").alias(f"_{end}"))
    out = edges.join(m("src"), "src", "left").join(m("dst"), "dst", "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns))


def surviving(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges with no end among removed (id)."""
    ids = removed.select("id").distinct()
    return edges.join(ids, edges.src == ids.id, "left_anti").join(ids, F.col("dst") == ids.id, "left_anti")


def build_graph(people: DataFrame, calls: DataFrame, txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, kind, cell) and edges (src, dst, kind, confidence, day, source) of people with phones and accounts, calls and transfers.

    people: id, cell, phone, account; phones and accounts that are null or blank have no node. Edges whose ends don't exist go.
    """
    has = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    phones = people.where(has("phone")).select("id", F.concat(F.lit("PHONE_"), "phone").alias("node"))
    accounts = people.where(has("account")).select("id", F.concat(F.lit("ACCT_"), "account").alias("node"))
    nodes = people.select("id", F.lit("Person").alias("kind"), "cell").unionByName(phones.select(F.col("node").alias("id"), F.lit("Phone").alias("kind"), F.lit("Phone").alias("cell")))
    nodes = nodes.unionByName(accounts.select(F.col("node").alias("id"), F.lit("Account").alias("kind"), F.lit("Account").alias("cell"))).dropDuplicates(["id"])
    edge = lambda df, src, dst, kind, conf, day, source: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"), day.cast("int").alias("day"), source.cast("string").alias("source"))
    none = F.lit(None)
    owned = edge(phones, "id", "node", "OWNS_PHONE", 1.0, none, F.lit("directory")).unionByName(edge(phones, "node", "id", "OWNED_BY", 1.0, none, F.lit("directory")))
    owned = owned.unionByName(edge(accounts, "id", "node", "OWNS_ACCOUNT", 1.0, none, F.lit("directory")))
    acts = edge(calls, "caller", "callee", "CALLED", 1.0, F.col("day"), F.col("call_id")).unionByName(edge(txns, "sender", "receiver", "TRANSACTED", 1.0, F.col("day"), F.col("txn_id")))
    return nodes, surviving(owned.unionByName(acts), nodes)


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree (parallel edges count, loops twice), neighbours (different ones), degree_centrality (neighbours over others)."""
    multi = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    simple = both_ways(undirected(edges)).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("neighbours"))
    out = multi.join(simple, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0).cast("long")))
    n = multi.agg(F.count("*").alias("n"))
    return out.join(F.broadcast(n)).select("id", "degree", "neighbours", F.round(F.when(F.col("n") > 1, F.col("neighbours") / (F.col("n") - 1)).otherwise(0.0), 4).alias("degree_centrality"))


def cross_cell_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, cross: different neighbours whose cell is known, not Noise and not the node's own."""
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("cell").alias(f"_{c}"))
    pairs = undirected(edges).join(end("a"), "a", "left").join(end("b"), "b", "left")
    crosses = lambda own, other: F.col(other).isNotNull() & (F.col(other) != "Noise") & ~F.col(other).eqNullSafe(F.col(own))
    side = lambda c, own, other: F.struct(F.col(c).alias("id"), crosses(own, other).alias("crosses"))
    ends = pairs.select(F.explode(F.array(side("a", "_a", "_b"), side("b", "_b", "_a"))).alias("e"))
    return ends.groupBy("e.id").agg(F.count_if("e.crosses").alias("cross"))


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """id, component (the least id in it); isolated ``nodes`` are their own.

    Minimum labels spread over edges, and each round also jumps to the label's own label, so long paths take a logarithm of rounds.
    """
    arcs = cut(both_ways(undirected(edges)))
    ids = arcs.select(F.col("u").alias("id")).distinct()
    if nodes is not None:
        ids = ids.union(nodes.select("id")).distinct()
    labels = cut(ids.select("id", F.col("id").alias("label")))
    for _ in range(max_rounds):
        near = arcs.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("low"))
        low = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("low", "label")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("up"))
        moved = cut(low.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("up", "new")).alias("new")))
        done = moved.where(F.col("label") != F.col("new")).isEmpty()
        labels = moved.select("id", F.col("new").alias("label"))
        if done:
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def hops(edges: DataFrame, source: object, most: int = 4) -> DataFrame:
    """id, hops: distance from a source, up to ``most`` steps; one join for each step over what is new."""
    arcs = both_ways(undirected(edges))
    seen = edges.sparkSession.createDataFrame([(source, 0)], arcs.schema["u"].dataType.simpleString().join(("id ", ", hops int")))
    front = seen
    for k in range(1, most + 1):
        front = arcs.join(front.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(k).alias("hops"))
        front = cut(front)
        seen = seen.union(front)
    return seen


def shortest_path(edges: DataFrame, source: object, target: object, most: int = 4) -> DataFrame:
    """One row with path (the first by its ids among the shortest) and hops, or none if it takes over ``most`` steps."""
    arcs = both_ways(undirected(edges))
    kind = arcs.schema["u"].dataType.simpleString()
    paths = edges.sparkSession.createDataFrame([(source, [source])], f"id {kind}, path array<{kind}>")
    for k in range(most + 1):
        found = paths.where(F.col("id") == F.lit(target)).orderBy("path").limit(1)
        if not (found := cut(found)).isEmpty():
            return found.select("path", F.lit(k).alias("hops"))
        step = paths.join(arcs, paths.id == arcs.u).where(~F.array_contains("path", F.col("v")))
        # of the paths to a node only the first can begin the first shortest path
        paths = cut(step.groupBy(F.col("v").alias("id")).agg(F.min(F.array_append("path", F.col("v"))).alias("path")))
    return found.select("path", F.lit(0).alias("hops"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """id, rank on the undirected simple graph from a uniform start; with ``tolerance``, until the summed change is below it per node."""
    arcs = cut(both_ways(undirected(edges)))
    out = arcs.groupBy("u").agg(F.count("*").alias("d"))
    n = out.count()
    ranks = cut(out.select(F.col("u").alias("id"), "d", F.lit(1.0 / max(n, 1)).alias("rank")))
    for k in range(rounds):
        given = arcs.join(ranks.select(F.col("id").alias("u"), (F.col("rank") / F.col("d")).alias("part")), "u").groupBy(F.col("v").alias("id")).agg(F.sum("part").alias("got"))
        new = ranks.join(given, "id").select("id", "d", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("got")).alias("rank"), F.col("rank").alias("old"))
        new = cut(new) if k % 5 == 4 or tolerance is not None else new
        if tolerance is not None and (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < n * tolerance:
            return new.select("id", "rank")
        ranks = new.select("id", "d", "rank")
    return ranks.select("id", "rank")


def _adjacency(edges: DataFrame) -> tuple[DataFrame, int, str, int] | None:
    """Different nodes in order (at from 0, id), how many they are, a folder of Parquet files that all executors share: their arcs as
    positions u, v, files and rows in order, and how many edges they are. None for a graph too large for each task to hold. The driver sees
    only counts."""
    spark = edges.sparkSession
    simple = cut(undirected(edges))
    if (m := simple.count()) > MAX_SEARCHED_EDGES:
        return None
    names = ranked(both_ways(simple).select(F.col("u").alias("id")).distinct(), "id", name="at")
    names = cut(names.select((F.col("at") - 1).cast("int").alias("at"), "id"))
    end = lambda c, to: names.select(F.col("id").alias(c), F.col("at").alias(to))
    arcs = both_ways(simple.join(end("a", "_a"), "a").join(end("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    folder = f"{shared_dir(spark)}/adjacency-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arcs.repartitionByRange(parts, "u").sortWithinPartitions("u", "v").write.parquet(folder)
    return names, names.count(), folder, m


def blocked_adjacency(edges: DataFrame, bits: int | None = None) -> tuple[DataFrame, int, str]:
    """Different nodes in order (at from 0, id, degree), how many they are, and a folder that all executors share: the arcs u, v as positions,
    a folder block=<k> for each 2**bits (BLOCK_BITS unless given) nodes u in order. At any size: a task reads the blocks that it needs, see block()."""
    spark = edges.sparkSession
    simple = stored(undirected(edges), "simple")
    degree = both_ways(simple).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    names = stored(ranked(degree, "id", name="at").select((F.col("at") - 1).cast("int").alias("at"), "id", "degree"), "names")
    end = lambda c, to: names.select(F.col("id").alias(c), F.col("at").alias(to))
    arcs = both_ways(simple.join(end("a", "_a"), "a").join(end("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    arcs = arcs.withColumn("block", F.shiftright("u", BLOCK_BITS if bits is None else bits))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arcs.repartition(parts, "block").sortWithinPartitions("block", "u", "v").write.partitionBy("block").parquet(folder)
    return names, names.count(), folder


def block(folder: str, k: int, bits: int) -> tuple:
    """Of a block of blocked_adjacency(): where each node's neighbours begin, and the neighbours of all."""
    return _near(f"{folder}/block={k}", 1 << bits, k << bits)


def _near(folder: str, n: int, first: int = 0) -> tuple:
    """From the files of _adjacency(): where each node's neighbours begin, and the neighbours of all, 4 bytes an arc; nodes count from ``first``."""
    import numpy as np
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-"))
    counts, rows = np.zeros(n, np.int64), []
    for path in files:
        with store.open_input_file(path) as f:
            rows.append(pq.read_metadata(f).num_rows)
    targets, at = np.empty(sum(rows), np.int32), 0
    for path, size in zip(files, rows, strict=True):
        with store.open_input_file(path) as f:
            arcs = pq.read_table(f)
        counts += np.bincount(arcs["u"].to_numpy() - first, minlength=n)
        targets[at : at + size] = arcs["v"].to_numpy()
        at += size
    return np.concatenate([[0], np.cumsum(counts)]), targets


def _arcs(near: tuple, of) -> Iterator[tuple]:
    """Slices a to b of positions ``of``, at about SEARCH_ARCS arcs at a time: where the arcs of each begin, and the other ends of all."""
    import numpy as np

    starts, targets = near
    counts = starts[of + 1] - starts[of]
    ends = np.cumsum(counts)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(SEARCH_ARCS, ends[-1], SEARCH_ARCS)).tolist(), len(of)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        begin = ends[a:b] - counts[a:b]
        begin = begin - begin[0]
        yield a, b, begin, targets[np.repeat(starts[of[a:b]] - begin, counts[a:b]) + np.arange(begin[-1] + counts[b - 1])]


def _row_sums(values, at, counts):
    """Sums of rows values[at], for each count that many in a row. Runs are cut into pieces of RUN and added up piece beside piece, the longest
    first, so that a step adds one row of each to whole blocks."""
    import numpy as np

    width = values.shape[1]
    pieces = -(-counts // RUN)
    first = np.cumsum(pieces) - pieces
    skip = RUN * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    begin = np.repeat(np.cumsum(counts) - counts, pieces) + skip
    size = np.minimum(np.repeat(counts, pieces) - skip, RUN)
    order = np.argsort(-size, kind="stable")
    sums, most = np.empty((len(order), width), values.dtype), max(1, (1 << 16) // width)
    got, more = np.empty((most, width), values.dtype), np.empty((most, width), values.dtype)
    for k in range(0, len(order), most):
        some = order[k : k + most]
        start, length = begin[some], size[some]
        values.take(at[start], axis=0, out=got[: len(some)], mode="clip")
        longer = len(some) - np.cumsum(np.bincount(length))
        for step in range(1, int(length[0])):
            c = int(longer[step])
            values.take(at[start[:c] + step], axis=0, out=more[:c], mode="clip")
            np.add(got[:c], more[:c], out=got[:c])
        sums[some] = got[: len(some)]
    return np.add.reduceat(sums, first, axis=0) if len(order) > len(counts) else sums


def _pulled(near: tuple, rows, front, values):
    """For each of rows the sum of values, a row for each of front, over its neighbours in front."""
    import numpy as np

    where = np.full(len(near[0]) - 1, -1)
    where[front] = np.arange(len(front))
    out = np.zeros((len(rows), values.shape[1]), values.dtype)
    for a, _, begin, other in _arcs(near, rows):
        at = where[other]
        keep = at >= 0
        counts = np.add.reduceat(keep, begin, dtype=np.int64)
        if len(has := np.flatnonzero(counts)):
            out[a + has] = _row_sums(values, at[keep], counts[has])
    return out


def _next_level(near: tuple, front, values, seen, unseen) -> tuple:
    """What a level (front, values: paths from each source) leads to: nodes that some source hasn't seen, their paths, and whether the level's own
    arcs were followed, as it has few; otherwise neighbours of the level look up what all sources have in it."""
    import numpy as np

    n, width = seen.shape
    degree = near[0][front + 1] - near[0][front]
    at, source = np.nonzero(values)
    arcs = int(degree[at].sum())
    if arcs <= SEARCH_ARCS and 16 * arcs < width * int(degree.sum()):
        other = np.concatenate([x[3] for x in _arcs(near, front[at])])
        to = other.astype(np.int64) * width + np.repeat(source, degree[at])
        keep = ~seen.reshape(-1)[to]
        found, sums = _sums(to[keep], np.repeat(values[at, source], degree[at])[keep], n * width)
        side, row = np.unique(found // width, return_inverse=True)
        paths = np.zeros((len(side), width), values.dtype)
        paths[row, found % width] = sums
        return side, paths, True
    touched = np.zeros(n, bool)
    for *_, other in _arcs(near, front):
        touched[other] = True
    side = np.flatnonzero(touched & (unseen > 0))
    if not len(side):
        return side, values[:0], False
    paths = _pulled(near, side, front, values)
    paths *= ~seen[side]
    keep = paths.any(1)
    return (side, paths, False) if keep.all() else (side[keep], paths[keep], False)


def _credits(near: tuple, sources):
    """Brandes' sums of each node over breadth-first searches from different ``sources`` at once, a column for each of them. Paths are counted in
    four bytes as long as these hold them exactly."""
    import numpy as np

    n, width = len(near[0]) - 1, len(sources)
    own, front, values = np.arange(width), sources, np.eye(width, dtype=np.float32)
    seen, unseen = np.zeros((n, width), bool), np.full(n, width)
    seen[sources, own] = True
    unseen[sources] -= 1
    levels = []
    while True:
        side, paths, few = _next_level(near, front, values, seen, unseen)
        if paths.dtype == np.float32 and paths.max(initial=0) >= 1 << 24:
            side, paths, few = _next_level(near, front, values.astype(np.float64), seen, unseen)
        if not len(side):
            break
        new = paths > 0
        seen[side] |= new
        unseen[side] -= new.sum(1)
        top = paths.max(0).astype(np.float64)
        top[top <= 1e200] = 1.0
        if (top > 1).any():  # only shares of a level count
            paths = np.where(new, np.maximum(paths / top, 1e-300), 0.0)
        at = np.nonzero(new) if 4 * np.count_nonzero(new) < new.size else None
        levels.append((side, paths if at is None else (at, paths[at]), top, few))
        front, values = side, paths
    total = np.zeros(n)

    def paths_of(k: int):
        side, kept, *_ = levels[k]
        if not isinstance(kept, tuple):
            return kept
        paths = np.zeros((len(side), width), kept[1].dtype)
        paths[kept[0]] = kept[1]
        return paths

    credit, values = 0.0, paths_of(-1) if levels else None
    for k in range(len(levels) - 1, 0, -1):
        front, _, top, few = levels[k]
        part = np.zeros((len(front), width))
        np.divide(1 + credit, values * top, out=part, where=values > 0)
        side, values = levels[k - 1][0], paths_of(k - 1)
        if few:
            at, source = np.nonzero(values)
            where = np.full(n, -1)
            where[front] = np.arange(len(front))
            credit = np.zeros(values.shape)
            for a, b, begin, other in _arcs(near, side[at]):
                to = where[other]
                shares = np.where(to >= 0, part[to, np.repeat(source[a:b], np.diff(begin, append=len(other)))], 0.0)
                credit[at[a:b], source[a:b]] = values[at[a:b], source[a:b]] * np.add.reduceat(shares, begin)
        else:
            credit = _pulled(near, side, front, part)
            credit *= values
        total[side] += credit.sum(1)
    return total


def _sums(at, values, n: int) -> tuple:
    """Different positions, in order, and the sums of their positive values."""
    import numpy as np

    if 4 * len(at) >= n:
        sums = np.bincount(at, values, n)
        return (found := np.flatnonzero(sums)), sums[found]
    found, which = np.unique(at, return_inverse=True)
    return found, np.bincount(which, values, len(found))


def _picked(ids: DataFrame, sources: int, seed: int = 0) -> DataFrame:
    """The first ids by a hash."""
    return ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sources)


def betweenness(edges: DataFrame, sources: int | None = None) -> DataFrame:
    """id, betweenness of nodes that have an edge: shortest paths through them, over (n-1)(n-2); by Brandes' sums, all nodes being sources.

    A graph of over MAX_SEARCHED_EDGES, which a task doesn't hold, goes through betweenness_by_rounds(), with all sources as well. With ``sources``
    that function takes so many; its column error says how far values may be off. MAX_BROADCAST_EDGES, if set, samples SOURCES of a larger graph.
    """
    import numpy as np
    import pandas as pd

    spark = edges.sparkSession
    small = _adjacency(edges) if sources is None else None
    if small is None:
        return betweenness_by_rounds(edges, sources).drop("error")
    names, n, folder, m = small
    count = n if MAX_BROADCAST_EDGES is None or m <= MAX_BROADCAST_EDGES else min(n, SOURCES)
    width = max(1, min(SEARCH_SOURCES, SEARCH_STATE // max(n, 1)))
    searches = -(-count // width)
    if count == n:  # neighbours in order share more of a search
        parts = spark.range(searches).select(F.sequence(F.col("id") * width, F.least((F.col("id") + 1) * width, F.lit(n)) - 1).alias("sources"))
    else:
        parts = _picked(names, count).groupBy(F.pmod("at", F.lit(searches))).agg(F.collect_list(F.col("at").cast("long")).alias("sources")).select("sources")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, total = _near(folder, n), np.zeros(n)
        for batch in batches:
            for some in batch["sources"]:
                total += _credits(near, np.sort(some))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "credit": total[at]}).astype({"at": "int64", "credit": "float64"})

    parts = parts.repartition(max(1, min(searches, 4 * spark.sparkContext.defaultParallelism)))
    sums = parts.mapInPandas(run, "at long, credit double").groupBy("at").agg(F.sum("credit").alias("credit"))
    scale = ((n - 1) * (n - 2) or 1) * (count / n if n else 1)
    return names.join(sums, "at", "left").select("id", F.coalesce(F.col("credit") / scale, F.lit(0.0)).alias("betweenness"))


def _pieces(batches: Iterator, bits: int) -> Iterator[tuple]:
    """((slice, block), rows) for runs of rows of one slice and block, as far as a batch holds them."""
    import numpy as np

    for batch in batches:
        if batch.num_rows:
            part, at = batch["slice"].to_numpy(), batch["at"].to_numpy() >> bits
            cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(at) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield (int(part[a]), int(at[a])), batch.slice(a, b - a)


def _matrix(column, kind):
    """Rows of SLICE numbers from a binary column without nulls."""
    import numpy as np

    begin = int(np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0])
    return np.frombuffer(column.buffers()[2], kind, len(column) * SLICE, begin).reshape(-1, SLICE)


def _column(matrix):
    """The other way round."""
    import numpy as np
    import pyarrow as pa

    size = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(matrix))])


def _rows(part: int, at, **columns):
    import numpy as np
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"slice": np.full(len(at), part, np.int32), "at": at.astype(np.int32), **columns})


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows (slice, at, ...) with those of a slice and block together, in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = rows.withColumn("block", F.shiftright("at", SLICE_BITS))
    return tagged.repartition(parts, "slice", "block").sortWithinPartitions(*order).select(*rows.columns)


def _pushed(rows: DataFrame, folder: str) -> DataFrame:
    """slice, at, x: rows (slice, at, x) summed over the arcs from each block to each node."""
    bits = SLICE_BITS

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        loaded, now, x, arcs = None, None, None, None

        def sums() -> Iterator:
            own, to = arcs
            keep = x.any(1)[own]
            own, to = own[keep], to[keep]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            counts = np.diff(first, append=len(to))
            for a in range(0, len(first), 1 << bits):
                some = counts[a : a + (1 << bits)]
                yield _rows(now[0], to[first[a : a + (1 << bits)]], x=_column(_row_sums(x, own[first[a] : first[a] + some.sum()], some)))

        for key, piece in _pieces(batches, bits):
            if key != now:
                if now is not None:
                    yield from sums()
                now, x = key, np.zeros((1 << bits, SLICE))
                if loaded != key[1]:
                    starts, targets = block(folder, key[1], bits)
                    order = np.argsort(targets, kind="stable")
                    arcs, loaded = (np.repeat(np.arange(1 << bits), np.diff(starts))[order], targets[order]), key[1]
            x[piece["at"].to_numpy() - (key[1] << bits)] = _matrix(piece["x"], np.float64)
        if now is not None:
            yield from sums()

    return _dealt(rows.select("slice", "at", "x"), "block", "slice", "at").mapInArrow(run, "slice int, at int, x binary")


def _met(own: DataFrame, column: str, kind: str, sums: DataFrame | None, finish: Callable, schema: str) -> DataFrame:
    """What finish(slice, first node, own, sums) makes of own's column, SLICE numbers of ``kind``, and of sums' x, added up, in each slice and block."""
    rows, bits = own.select("slice", "at", F.lit(0).alias("part"), F.col(column).alias("x")), SLICE_BITS
    if sums is not None:
        rows = rows.unionByName(sums.select("slice", "at", F.lit(1).alias("part"), "x"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        now, mine, total = None, None, None
        for key, piece in _pieces(batches, bits):
            if key != now:
                if now is not None:
                    yield finish(now[0], now[1] << bits, mine, total)
                now, mine, total = key, np.zeros((1 << bits, SLICE), kind), np.zeros((1 << bits, SLICE))
            at, n = piece["at"].to_numpy() - (key[1] << bits), int((piece["part"].to_numpy() == 0).sum())
            mine[at[:n]] = _matrix(piece.slice(0, n)["x"], kind)
            if n < len(at):
                first = np.flatnonzero(np.diff(at[n:], prepend=-1))
                total[at[n:][first]] += np.add.reduceat(_matrix(piece.slice(n)["x"], np.float64), first, axis=0)
        if now is not None:
            yield finish(now[0], now[1] << bits, mine, total)

    return _dealt(rows, "slice", "block", "part", "at").mapInArrow(run, schema)


def _searched(sources: DataFrame, folder: str) -> Iterator[DataFrame]:
    """For each step of breadth-first searches from sources (at, no from 0) its level: slice of the sources, at, x (paths from each of them) and
    pairs (how many of them reach the node in this step)."""

    def begun(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            no = batch["no"].to_numpy()
            one = no[:, None] % SLICE == np.arange(SLICE)
            yield pa.RecordBatch.from_pydict({"slice": (no // SLICE).astype(np.int32), "at": batch["at"].cast(pa.int32()), "seen": _column(one), "x": _column(one.astype(np.float64))})

    def finish(part: int, first: int, seen, sums):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        new = (sums > 0) & ~seen
        found = new.any(1)
        at = np.flatnonzero(found | seen.any(1))
        x = pc.if_else(pa.array(found[at]), _column(np.where(new[at], sums[at], 0.0)), pa.scalar(None, pa.binary()))
        return _rows(part, first + at, seen=_column(seen[at] | new[at]), x=x, pairs=new[at].sum(1))

    seen = front = cut(sources.select("at", "no").mapInArrow(begun, "slice int, at int, seen binary, x binary"))
    while True:
        seen = cut(_met(seen, "seen", "bool", _pushed(front, folder), finish, "slice int, at int, seen binary, x binary, pairs long"))
        front = seen.where("x IS NOT NULL")
        if front.isEmpty():
            return
        yield front.select("slice", "at", "x", "pairs")


def betweenness_by_rounds(edges: DataFrame, sources: int | None = None, batch: int | None = None, seed: int = 0, risk: float = 0.05) -> DataFrame:
    """id, betweenness and error at any size: Brandes' sums by rounds over blocks of nodes, ``batch`` sources at a time, so that a batch's state
    has at most batch * nodes numbers (unless given, as many as keep it within BATCH_ROWS, but 64 at least).

    A level is a row for each node and slice of SLICE sources. Forwards its rows meet the adjacency of their block in the shared folder, and what
    a block gives to each node, summed, is dealt out to the node's block, which knows what was reached before; backwards each level's shares
    go the same way. With ``sources`` only that many, the first by a hash, are searched and sums scaled up; then all values together are off by
    more than error with a chance of at most ``risk`` (Hoeffding's bound over the sources, each giving a share between 0 and 1, for all nodes).
    Without, every node is a source and error is 0. Numbers of paths are doubles.
    """
    names, n, folder = blocked_adjacency(edges, SLICE_BITS)
    if sources is None or sources >= n:
        picked, count, error = names.select("at", F.col("at").alias("no")), n, 0.0
    else:
        picked, count = ranked(_picked(names, sources, seed).select("at"), "at", name="no").select("at", F.col("no") - 1), sources
        picked = picked.toDF("at", "no")
        error = n / max(n - 1, 1) * math.sqrt(math.log(2 * n / risk) / (2 * count))
    picked, size = cut(picked), batch or max(64, BATCH_ROWS // max(n, 1))

    def finish(part: int, first: int, paths, shares):
        import numpy as np

        at = np.flatnonzero(paths.any(1))
        paths, credit = paths[at], paths[at] * shares[at]
        x = np.zeros(paths.shape)
        np.divide(1 + credit, paths, out=x, where=paths > 0)
        return _rows(part, first + at, x=_column(x), credit=credit.sum(1))

    total = None
    for k in range(max(1, -(-count // size))):
        mine = picked.select("at", (F.col("no") - k * size).alias("no")).where(f"no >= 0 AND no < {size}")
        beyond = None
        for level in reversed([*_searched(mine, folder)]):
            beyond = cut(_met(level, "x", "float64", None if beyond is None else _pushed(beyond, folder), finish, "slice int, at int, x binary, credit double"))
            part = beyond.groupBy(F.col("at").alias("id")).agg(F.sum("credit").alias("d"))
            total = part if total is None else total.union(part)
        if total is not None:
            total = cut(total.groupBy("id").agg(F.sum("d").alias("d")))
    scale = n / max(count, 1) / ((n - 1) * (n - 2) or 1)
    credit = F.lit(0.0) if total is None else F.coalesce(F.col("d") * scale, F.lit(0.0))
    out = names.select("at", "id") if total is None else names.select("at", "id").join(total.withColumnRenamed("id", "at"), "at", "left")
    return out.select("id", credit.alias("betweenness"), F.lit(error).alias("error"))


def efficiency_by_rounds(edges: DataFrame, nodes: DataFrame | None = None) -> float:
    """efficiency() at any size by the searches of betweenness_by_rounds(), exactly."""
    names, linked, folder = blocked_adjacency(edges, SLICE_BITS)
    n = linked if nodes is None else nodes.select("id").union(edges.select("src")).union(edges.select("dst")).distinct().count()
    if n < 2 or not linked:
        return 0.0
    size, total = max(64, BATCH_ROWS // linked), 0.0
    for k in range(-(-linked // size)):
        mine = names.select("at", (F.col("at") - k * size).alias("no")).where(f"no >= 0 AND no < {size}")
        for hop, level in enumerate(_searched(mine, folder), 1):
            total += level.agg(F.sum("pairs")).first()[0] / hop
    return total / (n * (n - 1))


def efficiency_by_hops(edges: DataFrame, nodes: DataFrame | None = None, bits: int = 10) -> tuple[float, float]:
    """(efficiency, its relative standard error) at any size, from the sizes of neighbourhoods.

    Each node's neighbourhood of k hops is a HyperLogLog sketch of 2**bits registers; one more hop unites those of its neighbours along the arcs.
    The pairs at distance k are what all sketches together grow by; a sketch is off by 1.04 / sqrt(2**bits), all nodes' together mostly by less.
    Rounds end when no sketch grows.
    """
    arcs = cut(both_ways(undirected(edges)))
    ids = arcs.select(F.col("u").alias("id")).distinct()
    n = ids.count() if nodes is None else nodes.select("id").union(edges.select("src")).union(edges.select("dst")).distinct().count()
    if n < 2 or arcs.isEmpty():
        return 0.0, 0.0
    balls = cut(ids.groupBy("id").agg(F.hll_sketch_agg("id", bits).alias("ball")))
    size = lambda: balls.agg(F.sum(F.hll_sketch_estimate("ball"))).first()[0]
    total, last, hop = 0.0, size(), 0
    while True:
        hop += 1
        heard = arcs.join(balls.select(F.col("id").alias("v"), "ball"), "v").select(F.col("u").alias("id"), "ball")
        balls = cut(heard.union(balls).groupBy("id").agg(F.hll_union_agg("ball").alias("ball")))
        now = size()
        if now <= last:
            return total / (n * (n - 1)), 1.04 / math.sqrt(1 << bits)
        total, last = total + (now - last) / hop, now


def efficiency(edges: DataFrame, nodes: DataFrame | None = None) -> float:
    """Mean of 1 / distance over ordered pairs of nodes (isolated ``nodes`` count); 0 for fewer than two. Beyond MAX_SEARCHED_EDGES edges, which
    a task doesn't hold, by efficiency_by_rounds(), exactly too; efficiency_by_hops() estimates it."""
    import pandas as pd

    spark = edges.sparkSession
    small = _adjacency(edges)
    if small is None:
        return efficiency_by_rounds(edges, nodes)
    _, linked, folder, _ = small
    n = linked if nodes is None else nodes.select("id").union(edges.select("src")).union(edges.select("dst")).distinct().count()
    if n < 2 or not linked:
        return 0.0
    size = 64 * SEARCH_WORDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, found = _near(folder, linked), {}
        for batch in batches:
            for k in batch["id"].tolist():
                for hop, pairs in enumerate(_reached(near, k * size, min(size, linked - k * size)), 1):
                    found[hop] = found.get(hop, 0) + pairs
        yield pd.DataFrame({"hop": list(found), "pairs": list(found.values())}).astype("int64")

    searches = -(-linked // size)
    parts = spark.range(searches).repartition(max(1, min(searches, 4 * spark.sparkContext.defaultParallelism)))
    by_hop = parts.mapInPandas(run, "hop long, pairs long").groupBy("hop").agg(F.sum("pairs").alias("pairs"))
    return (by_hop.agg(F.sum(F.col("pairs") / F.col("hop"))).first()[0] or 0.0) / (n * (n - 1))


def _reached(near: tuple, first: int, count: int) -> Iterator[int]:
    """For each step of breadth-first searches from ``count`` nodes at once how many pairs of source and node are new. A node has a bit for each
    source; what is new comes from the last level's bits of its neighbours, for neighbours of that level that some source hasn't seen."""
    import numpy as np

    words, n = -(-count // 64), len(near[0]) - 1
    seen, front = np.zeros((words, n), np.uint64), np.zeros((words, n), np.uint64)
    sources = np.arange(count)
    seen[sources >> 6, first + sources] = np.uint64(1) << (sources & 63).astype(np.uint64)
    front[:] = seen
    every = np.bitwise_or.reduce(seen, axis=1)

    last = first + sources
    while len(last):
        touched = np.zeros(n, bool)
        for *_, other in _arcs(near, last):
            touched[other] = True
        side = np.flatnonzero(touched)
        side = side[(seen[:, side] != every[:, None]).any(0)]
        new, pairs = [], 0
        if len(side):
            for a, b, begin, other in _arcs(near, side):
                some = side[a:b]
                bits = np.stack([np.bitwise_or.reduceat(front[w][other], begin) for w in range(words)]) & ~seen[:, some]
                keep = bits.any(0)
                new.append((some[keep], bits[:, keep]))
        front[:, last] = 0
        for some, bits in new:
            seen[:, some] |= bits
            front[:, some] = bits
            pairs += int(np.bitwise_count(bits).sum())
        last = np.concatenate([np.zeros(0, np.int64), *(some for some, _ in new)])
        if pairs:
            yield pairs


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, label after synchronous rounds in which each node takes its own and its neighbours' most frequent label, the least on ties."""
    arcs = cut(both_ways(undirected(edges)))
    labels = cut(arcs.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("label")))
    for k in range(rounds):
        heard = arcs.join(labels.select(F.col("id").alias("v"), "label"), "v").select(F.col("u").alias("id"), "label").union(labels)
        votes = heard.groupBy("id", "label").agg(F.count("*").alias("n"))
        labels = votes.groupBy("id").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"))
        labels = cut(labels) if k % 2 else labels
    return labels


def louvain(edges: DataFrame, rounds: int = 8, levels: int = 4) -> DataFrame:
    """id, community (its least id) by modularity on the undirected simple graph: moves by rounds of joins, then contraction.

    In a round every node looks up what it would gain in the communities of its neighbours, and of those that gain a half, chosen by a hash
    of node and round, moves, so that neighbours don't forever change places. Ties go to the least community. A level ends when
    no node gains or after ``rounds``; communities then become nodes, until a level changes nothing. Weights are whole numbers, so the
    result is the same however rows are dealt. Rounds end in written tables: a checkpoint keeps what the planner inferred of its columns, which
    grows with every join until planning takes longer than the round.
    """
    arcs = stored(both_ways(undirected(edges)).select("u", "v", F.lit(1).cast("long").alias("w")))
    total = arcs.agg(F.sum("w")).first()[0] or 1
    member = stored(arcs.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("c")))
    for level in range(levels):
        weight = stored(arcs.groupBy("u").agg(F.sum("w").alias("k")))
        group = weight.select("u", F.col("u").alias("c"), "k")
        near = arcs.where("u <> v")
        for k in range(rounds):
            sums = group.groupBy("c").agg(F.sum("k").alias("sum_k"))
            to = near.join(group.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
            own = group.select("u", "c", F.lit(0).cast("long").alias("w"))
            each = to.unionByName(own).groupBy("u", "c").agg(F.sum("w").alias("w")).join(sums, "c").join(group.select("u", F.col("c").alias("old"), "k"), "u")
            gain = F.col("w") * F.lit(total) - (F.col("sum_k") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0)) * F.col("k")
            each = each.select("u", "c", "old", "k", gain.alias("gain"))
            best = each.groupBy("u").agg(F.min_by(F.struct("c", "gain"), F.struct(-F.col("gain"), "c")).alias("b"), F.max(F.when(F.col("c") == F.col("old"), F.col("gain"))).alias("now"), F.first("old").alias("old"), F.first("k").alias("k"))
            gains = F.col("b.gain") > F.col("now")
            moves = gains & (F.pmod(F.xxhash64("u", F.lit(level), F.lit(k)), F.lit(2)) == 0)
            moved = stored(best.select("u", F.when(moves, F.col("b.c")).otherwise(F.col("old")).alias("c"), "k", gains.alias("gains")))
            group = moved.select("u", "c", "k")
            if moved.where("gains").isEmpty():
                break
        if group.where("u <> c").isEmpty():
            break
        member = stored(member.join(group.select(F.col("u").alias("c"), F.col("c").alias("new")), "c").select("id", F.col("new").alias("c")))
        ends = arcs.join(group.select("u", F.col("c").alias("cu")), "u").join(group.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
        arcs = stored(ends.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    least = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(least, "c").select("id", "community")


def community_profile(communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """community, size, dominant_cell (most members, first by name on ties), cell_breakdown (map), by size."""
    cells = communities.join(nodes.select("id", F.coalesce("cell", F.lit("Unknown")).alias("cell")), "id", "left").groupBy("community", "cell").agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), F.col("cell"))
    out = cells.groupBy("community").agg(F.sum("n").alias("size"), F.min_by("cell", order).alias("dominant_cell"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell", "n")))).alias("cell_breakdown"))
    return out.orderBy(F.desc("size"), "community")


def snapshot(edges: DataFrame, day: int, span: int = 6) -> DataFrame:
    """Edges of the ``span`` days up to ``day`` and those without one, with opacity: 1 on the day itself or undated, then fading."""
    age = F.lit(day) - F.col("day")
    seen = edges.where(F.col("day").isNull() | F.col("day").between(day - span, day))
    fade = F.round(0.35 + 0.65 * (1 - age / span), 2)
    return seen.withColumn("opacity", F.when(F.col("day").isNull() | (F.col("day") == day), F.lit(1.0)).otherwise(fade))


def incident_nodes(edges: DataFrame, nodes: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """Nodes that some edge touches, and those in ``always`` (id)."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if always is not None:
        ids = ids.union(always.select("id"))
    return nodes.join(ids.distinct(), "id", "left_semi")


def edge_kind_counts(edges: DataFrame) -> DataFrame:
    """id, kind, n: edges of each kind at each node."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), "kind")
    return ends.groupBy("id", "kind").agg(F.count("*").alias("n"))


def evidence_quality(edges: DataFrame) -> DataFrame:
    """id, quality: mean confidence of a node's edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "confidence")
    return ends.groupBy("id").agg(F.avg("confidence").alias("quality"))


def bridges(centrality: DataFrame, cross: DataFrame, top: int = 6, w_between: float = 0.6, w_cross: float = 0.4) -> DataFrame:
    """Nodes (centrality: id, cell, betweenness; Noise left out) by w_between * min-max betweenness + w_cross * cross / greatest cross:
    id, cell, betweenness, norm_betweenness, cross, bridge_score, rank, flagged."""
    cross = cut(cross)
    known = cut(centrality.where(F.coalesce("cell", F.lit("Unknown")) != "Noise").join(cross, "id", "left").withColumn("cross", F.coalesce("cross", F.lit(0).cast("long"))))
    ends = known.agg(F.min("betweenness").alias("lo"), F.max("betweenness").alias("hi"))
    most = cross.agg(F.greatest(F.max("cross"), F.lit(1)).alias("most"))
    span = F.when(F.col("hi") != F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    norm = (F.col("betweenness") - F.col("lo")) / span
    scored = known.join(F.broadcast(ends)).join(F.broadcast(most)).select("id", "cell", "betweenness", F.round(norm, 4).alias("norm_betweenness"), "cross", F.round(w_between * norm + w_cross * F.col("cross") / F.coalesce("most", F.lit(1)), 4).alias("bridge_score"))
    places = ranked(scored, F.desc("bridge_score"), F.col("id"))
    return places.select("id", "cell", "betweenness", "norm_betweenness", "cross", "bridge_score", F.col("rank").cast("int").alias("rank"), (F.col("rank") <= top).alias("flagged"))


def what_if(edges: DataFrame, nodes: DataFrame, remove: object) -> DataFrame:
    """What removing a node does: counts of nodes, edges and components before and after, and impact (60 % edge loss, 40 % new fragments)."""
    spark = edges.sparkSession
    kind = nodes.schema["id"].dataType.simpleString()
    gone = spark.createDataFrame([(remove,)], f"id {kind}")
    left, rest = without(edges, gone), nodes.join(gone, "id", "left_anti")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    count = lambda e, v, name: components(e, v).agg(F.count_distinct("component").alias(name))
    row = n(edges, "edges_before").join(n(left, "edges_after")).join(n(nodes, "nodes_before")).join(n(rest, "nodes_after")).join(count(edges, nodes, "components_before")).join(count(left, rest, "components_after"))
    loss = (F.col("edges_before") - F.col("edges_after")) / F.greatest(F.col("edges_before"), F.lit(1))
    gain = F.greatest(F.lit(0), F.col("components_after") - F.col("components_before")) / F.greatest(F.col("components_before"), F.lit(1))
    return row.select("*", F.round(100 * (0.6 * loss + 0.4 * F.least(F.lit(1.0), gain)), 1).alias("impact"))


def takedown(edges: DataFrame, nodes: DataFrame, targets: DataFrame, before: float | None = None) -> DataFrame:
    """Effect of removing targets (id): efficiency before (given, if it is known) and after (each over its own pairs), disruption in percent
    (0 to 100), components left, edges severed."""
    left, rest = without(edges, targets), nodes.join(targets.select("id"), "id", "left_anti")
    before = efficiency(edges, nodes) if before is None else before
    after = efficiency(left, rest)
    fragments = components(left, rest).agg(F.count_distinct("component").alias("fragments"))
    severed = edges.agg(F.count("*").alias("n")).join(left.agg(F.count("*").alias("m"))).select((F.col("n") - F.col("m")).alias("severed"))
    drop = min(100.0, max(0.0, (1 - after / before) * 100)) if before else 0.0
    return fragments.join(severed).select(F.lit(round(before, 4)).alias("efficiency_before"), F.lit(round(after, 4)).alias("efficiency_after"), F.lit(round(drop, 1)).alias("disruption_pct"), "fragments", "severed")


def kind_histogram(edges: DataFrame) -> DataFrame:
    """kind, n."""
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def query(nodes: DataFrame, edges: DataFrame, text: str, **params: object) -> DataFrame:
    """A read in SQL over the tables {nodes} and {edges}, values given as :name; what a graph store answers by patterns is a join here."""
    return nodes.sparkSession.sql(text, args=params or None, nodes=nodes, edges=edges)
