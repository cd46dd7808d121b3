"""Evidence between two parties, for all pairs at once; a pair is p < q. Directed counts keep which side acted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netfusion import session
from netfusion.operators import graph
from netfusion.session import by_rows, stored

#: Evidence points from which a tie has a label.
STRENGTHS = (
    (8, "Direct Coordinated Operational Link (Critical)"),
    (4, "Strong Financial / Communication Tie (High)"),
    (2, "Corroborated Association (Moderate)"),
)
WEAKEST = "Indirect or Low-Frequency Link"


def _paired(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).withColumns({"p": F.least(a, b), "q": F.greatest(a, b), "forth": F.col(a) < F.col(b)})


def _dealt(t: DataFrame, n: int | None) -> DataFrame:
    return t if n is None else by_rows(t, n, "p", "q")


def telephony(calls: DataFrame, n: int | None = None) -> DataFrame:
    """p, q, calls, calls_p (made by p), calls_q, minutes (1 digit), n_days. n: how many calls there are, or about so many, if known; as many
    tasks as they need then count them."""
    t = _dealt(_paired(calls, "caller", "callee").select("p", "q", "forth", "duration", "day"), n)
    return t.groupBy("p", "q").agg(
        F.count("*").alias("calls"), F.count_if("forth").alias("calls_p"), F.count_if(~F.col("forth")).alias("calls_q"), F.round(F.sum("duration") / 60.0, 1).alias("minutes"), F.count_distinct("day").alias("n_days")
    )


def top_towers(calls: DataFrame, most: int = 4) -> DataFrame:
    """p, q, towers: the pair's most used towers (by name on ties)."""
    per = _paired(calls, "caller", "callee").groupBy("p", "q", "tower").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tower")))
    return per.groupBy("p", "q").agg(F.slice(F.transform(ordered, lambda x: x["tower"]), 1, most).alias("towers"))


def financials(txns: DataFrame, n: int | None = None) -> DataFrame:
    """p, q, txns, amount, amount_p (sent by p), amount_q. n as in telephony()."""
    t = _dealt(_paired(txns, "sender", "receiver").select("p", "q", "forth", "amount"), n)
    sent = lambda c: F.sum(F.when(c, F.col("amount")).otherwise(0))
    return t.groupBy("p", "q").agg(F.count("*").alias("txns"), F.sum("amount").alias("amount"), sent(F.col("forth")).alias("amount_p"), sent(~F.col("forth")).alias("amount_q"))


def call_counts(calls: DataFrame) -> DataFrame:
    return _paired(calls, "caller", "callee").groupBy("p", "q").agg(F.count("*").alias("calls"))


def co_mentions(mentions: DataFrame) -> DataFrame:
    """p, q, source_type, n_docs: documents that mention both. mentions: id, doc_id, source_type. All pairs are the answer, so a document that
    names n people makes n * (n - 1) / 2 rows before they are counted; they are spread by the join, which Spark splits where a document is large."""
    m = mentions.select("id", "doc_id", "source_type").distinct()
    other = m.select(F.col("id").alias("q"), "doc_id", "source_type")
    both = m.withColumnRenamed("id", "p").join(other, ["doc_id", "source_type"]).where("p < q")
    return both.groupBy("p", "q", "source_type").agg(F.count("*").alias("n_docs"))


def mutual_neighbours(edges: DataFrame, p: object, q: object) -> DataFrame:
    """id of the nodes next to both p and q."""
    ends = lambda x: edges.where(F.col("src") == F.lit(x)).select(F.col("dst").alias("id")).union(edges.where(F.col("dst") == F.lit(x)).select(F.col("src").alias("id")))
    return ends(p).intersect(ends(q)).where(~F.col("id").isin(p, q))


def mutual_counts(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """p, q, mutual: common neighbours of each given pair."""
    return with_mutual(pairs.select("p", "q"), edges)


def with_mutual(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (p, q and more columns) with mutual, the common neighbours of p and q; 0 where one of them has none.

    The adjacency lies in the shared folder in blocks of nodes, and pairs are sorted by the blocks of their ends, so a task holds two blocks
    at a time and no neighbour is shuffled for a pair. Of each pair the neighbours of the end with fewer are looked up among the other's.
    """
    pairs = stored(pairs, "pairs")
    names, n, folder = graph.blocked_adjacency(edges)
    end = lambda c: names.select(F.col("id").alias(c), F.struct("degree", "at").alias(f"_{c}"))
    placed = pairs.join(end("p"), "p", "left").join(end("q"), "q", "left").withColumns({"_x": F.greatest("_p", "_q")["at"], "_y": F.least("_p", "_q")["at"]})
    both = F.col("_p").isNotNull() & F.col("_q").isNotNull()
    order = [F.shiftright("_x", graph.BLOCK_BITS), F.shiftright("_y", graph.BLOCK_BITS), F.col("_x"), F.col("_y")]
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = placed.where(both).select(*pairs.columns, "_x", "_y").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*pairs.schema.fields, T.StructField("mutual", T.LongType())])
    alone = placed.where(~both).select(*pairs.columns, F.lit(0).cast("long").alias("mutual"))
    return met.mapInArrow(_count_mutual(n, folder), schema).unionByName(alone)


def _count_mutual(n: int, folder: str) -> Callable:
    """For batches sorted by the blocks of _x and _y, then by _x: their columns and how many neighbours of _y are neighbours of _x."""
    import numpy as np
    import pyarrow as pa

    bits = graph.BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark, low = {}, np.zeros(n, bool), (1 << bits) - 1

        def block(k: int, other: int) -> tuple:
            if k not in held:
                for old in [x for x in held if x != other]:
                    del held[old]
                held[k] = graph.block(folder, k, bits)
            return held[k]

        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("_x", "_y"))
            mutual = np.zeros(len(x), np.int64)
            runs = np.flatnonzero(np.diff(x, prepend=-1) | np.diff(y >> bits, prepend=-1))
            for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(x)], strict=True):
                kx, ky = int(x[a]) >> bits, int(y[a]) >> bits
                (at, near), (starts, targets) = block(kx, ky), block(ky, kx)
                own = near[at[x[a] & low] : at[(x[a] & low) + 1]]
                begin, counts = starts[y[a:b] & low], np.diff(starts)[y[a:b] & low]
                last = np.cumsum(counts)
                mark[own] = True
                hits = np.cumsum(mark[targets[np.repeat(begin - last + counts, counts) + np.arange(last[-1])]])
                mark[own] = False
                mutual[a:b] = np.diff(hits[last - 1], prepend=0)  # every node has a neighbour
            columns = [c for c in batch.schema.names if c not in ("_x", "_y")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(mutual)], names=[*columns, "mutual"])

    return run


def evidence_points(calls: Column, txns: Column, firs: Column, surveillance: Column, intel: Column, direct: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(z(calls) > 0, F.least(F.lit(4), F.floor(z(calls) / 5) + 1)).otherwise(0)
        + F.when(z(txns) > 0, F.least(F.lit(4), 2 * z(txns))).otherwise(0)
        + 3 * z(firs) + 3 * z(surveillance) + 2 * z(intel) + F.when(direct, 2).otherwise(0)
    ).cast("int")


def strength(points: Column) -> Column:
    out = None
    for least, label in STRENGTHS:
        out = F.when(points >= least, label) if out is None else out.when(points >= least, label)
    return out.otherwise(WEAKEST)


def by_identity(acts: DataFrame, people: DataFrame, sides: tuple[str, str] = ("caller", "callee"), number: str = "phone") -> DataFrame:
    """acts with both sides as directory ids, a row for each act and pair that it is between.

    A side is a person if its id or name is the person's id or name (without case), or its ``number`` (phone: digits only; account) is
    the person's. acts: <side>_id, <side>_name, <side>_<number> and more columns; people: id, name and the number. A side that fits several
    people stands for each; what fits nobody, or the same person on both sides, goes. Different ends are looked up once, however
    many acts they have.
    """
    return identified(acts, people, sides, number)[0]


def identified(acts: DataFrame, people: DataFrame, sides: tuple[str, str] = ("caller", "callee"), number: str = "phone") -> tuple[DataFrame, int]:
    """by_identity() and about how many rows it has (as if who stands at one side didn't depend on the other), at least the number of acts.

    Acts meet their ends in as many tasks as those rows need, so a task's memory doesn't grow with the acts; an end of more rows than a
    task holds is dealt to several.
    """
    a, b = sides
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    bare = (lambda c: F.regexp_replace(low(c), r"\D", "")) if number == "phone" else low
    end = lambda s: F.struct(low(f"{s}_id").alias("i"), low(f"{s}_name").alias("n"), bare(f"{s}_{number}").alias("x"))
    keys = lambda i, n, x: F.array_distinct(F.filter(F.array(F.concat(F.lit("n:"), i), F.concat(F.lit("n:"), n), F.concat(F.lit("x:"), x)), lambda k: F.length(k) > 2))
    # taken once, so that what is only needed for it goes no further
    spread = F.pmod(F.xxhash64(*(c for c, kind in acts.dtypes if "map<" not in kind)), F.lit((1 << 31) - 1)).cast("int")
    named = acts.withColumns({"_a": end(a), "_b": end(b), "_spread": spread})
    each_end = F.array(F.struct(F.col("_a").alias("e"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("_b").alias("e"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    ends = named.select(F.explode(each_end).alias("s")).groupBy("s.e").agg(F.sum("s.a").alias("as_a"), F.sum("s.b").alias("as_b"))
    ends = stored(ends, "ends")
    n_people, n_ends = people.count(), ends.count()
    known = by_rows(people.select("id", keys(low("id"), low("name"), bare(number)).alias("keys")), n_people, "id").select("id", F.explode("keys").alias("key")).distinct()
    asked = ends.select("e", "as_a", "as_b", F.explode_outer(keys(F.col("e.i"), F.col("e.n"), F.col("e.x"))).alias("key"))
    asked = by_rows(asked, n_people + n_ends, "key").join(by_rows(known, n_people + n_ends, "key"), "key", "left")
    who = by_rows(asked, n_ends, "e").groupBy("e").agg(F.max("as_a").alias("as_a"), F.max("as_b").alias("as_b"), F.array_sort(F.collect_set("id")).alias("ids"))
    who = stored(who.withColumns({f"rows_{s}": F.col(f"as_{s}") * F.size("ids") for s in "ab"}), "who")
    total = who.agg(*(F.coalesce(f(c), F.lit(0)).alias(c) for f, c in ((F.sum, "as_a"), (F.sum, "rows_a"), (F.sum, "rows_b")))).first()
    n = max(total.as_a, total.rows_a * total.rows_b // max(total.as_a, 1))
    rest = [c for c in acts.columns if c not in sides]

    def met(acts: DataFrame, s: str) -> DataFrame:
        parts = F.ceil(F.col(f"rows_{s}") / session.TASK_ROWS).cast("int")
        some = who.select(F.col("e").alias(f"_{s}"), F.col("ids").alias(f"_{s}s"), parts.alias("_parts")).where("_parts > 0")
        large = F.broadcast(some.where("_parts > 1").select(f"_{s}", "_parts"))  # at most a row for each task
        acts = acts.join(large, f"_{s}", "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod("_spread", F.col("_parts"))).cast("int")).drop("_parts")
        some = some.select(f"_{s}", f"_{s}s", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
        return by_rows(acts, n, f"_{s}", "_part").join(by_rows(some, n, f"_{s}", "_part"), [f"_{s}", "_part"]).drop("_part")

    each = F.flatten(F.transform("_as", lambda p: F.transform(F.col("_bs"), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    # an act between two people who both fit both sides is one act, not one each way
    once = lambda x: (x["p"] < x["q"]) | ((x["p"] > x["q"]) & ~(F.array_contains("_as", x["q"]) & F.array_contains("_bs", x["p"])))
    out = met(met(named, "a"), "b").select(*rest, F.explode(F.filter(each, once)).alias("_e"))
    return out.select(*rest, F.col("_e.p").alias(a), F.col("_e.q").alias(b)), n


def explain(calls: DataFrame, txns: DataFrame, mentions: DataFrame | None = None, edges: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Every pair with any tie: its counts, evidence_points, relationship_strength and a story; with ``edges`` also direct_edges and mutual
    (common neighbours), with ``people`` (id, name, role) a first sentence with their names."""
    out = telephony(calls).join(financials(txns), ["p", "q"], "full").join(top_towers(calls, 1).select("p", "q", F.get("towers", 0).alias("top_tower")), ["p", "q"], "left")
    kinds = ("fir", "surveillance", "intel")
    if mentions is not None:
        shared = co_mentions(mentions).groupBy("p", "q").pivot("source_type", list(kinds)).agg(F.sum("n_docs"))
        out = out.join(shared, ["p", "q"], "full")
    else:
        out = out.withColumns({k: F.lit(0).cast("long") for k in kinds})
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    if edges is not None:
        linked = _paired(edges, "src", "dst").groupBy("p", "q").agg(F.count("*").alias("direct_edges"))
        out = out.join(linked, ["p", "q"], "full").withColumn("direct_edges", F.coalesce("direct_edges", F.lit(0)))
        out = with_mutual(out, edges)
        direct = F.col("direct_edges") > 0
    else:
        direct = some("calls") | some("txns")
    out = out.withColumn("evidence_points", evidence_points(F.col("calls"), F.col("txns"), *(F.col(k) for k in kinds), direct))
    lead = []
    if people is not None:
        called = lambda end: people.select(F.col("id").alias(end), F.coalesce(F.col("name"), F.col("id").cast("string")).alias(f"name_{end}"), F.coalesce("role", F.lit("Suspect")).alias(f"role_{end}"))
        out = out.join(called("p"), "p", "left").join(called("q"), "q", "left")
        lead = [F.format_string("%s (%s) and %s (%s)", F.coalesce("name_p", F.col("p").cast("string")), F.coalesce("role_p", F.lit("Entity")), F.coalesce("name_q", F.col("q").cast("string")), F.coalesce("role_q", F.lit("Entity")))]
    story = F.concat_ws(
        "; ",
        *lead,
        F.when(F.col("calls") > 0, F.format_string("%d calls over %d days (%.1f minutes), most at %s", "calls", "n_days", "minutes", "top_tower")),
        F.when(F.col("txns") > 0, F.format_string("%d transfers of %d in all", "txns", "amount")),
        *(F.when(F.col(k) > 0, F.format_string(f"%d shared {k} records", F.col(k))) for k in kinds),
        *([F.when(F.col("mutual") > 0, F.format_string("%d mutual contacts", "mutual"))] if edges is not None else []),
    )
    out = out.select("*", strength(F.col("evidence_points")).alias("relationship_strength"), story.alias("story"))
    return out.drop("name_p", "name_q", "role_p", "role_q")
