"""Mixing sources to target weights.

Source shares of tokens are exponentiated (p ** a, normalised); bisection finds the flattest exponent whose most repeated source stays
within a limit, or the steepest whose entropy still reaches a target. The weights times a token budget are realised as block
permutations: documents are dealt into blocks by a hash, each epoch has its own order of a source's blocks, and a source's budget takes
whole epochs, then blocks of one more epoch, then documents of the block where it ends.

All is DataFrame functions. What a document needs to know of its source are a few numbers (the block and the document where the last
epoch ends), so texts are never shuffled and no source, however large, meets in one task: only its block totals do, MAX_BLOCKS at most.
Sources may be many: the driver gets sums over them, never a list of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netfusion.llm.common import WORD, cut, written

MIX_COLUMNS = ("mix_tokens", "mix_epoch", "mix_block", "mix_order")
STEPS, LEVELS = 20, 5
BLOCK_DOCS = 256
#: A source has no more blocks than this; beyond 16.8 million documents its blocks hold more than BLOCK_DOCS. Nothing is dropped, but a
#: prefix by mix_order meets the weights up to larger blocks.
MAX_BLOCKS = 1 << 16
#: With more sources than this their plan is joined by a shuffle, which Spark splits where a source is large.
BROADCAST_SOURCES = 100_000


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def _fraction(h: Column) -> Column:
    """A hash's first 13 hex digits as a number from 0 to 1 (exclusive)."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def exponent(shares: DataFrame, budget_ratio: float, max_repeat: float | None, min_entropy: float | None) -> float:
    """The exponent in [0, 1] for a table of shares (p, greater than 0); 1 if no exponent is within the repetition limit, 0 if none
    reaches the entropy. STEPS halvings, LEVELS of them from one aggregation over all shares: it sums at each point that they may ask for.
    """

    def measure(points: list[float]) -> dict[float, bool]:
        """For each point if the wanted exponent lies above it (entropy: at it or above it)."""
        powers = [F.pow("p", F.lit(a)) for a in points]
        sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(powers)] + [F.sum(x * F.log(x)).alias(f"l{k}") for k, x in enumerate(powers)]
        row = shares.agg(F.min("p").alias("least"), *sums).first()
        if min_entropy is not None:
            return {a: math.log(row[f"s{k}"]) - row[f"l{k}"] / row[f"s{k}"] >= min_entropy for k, a in enumerate(points)}
        return {a: row["least"] ** (a - 1) * budget_ratio / row[f"s{k}"] > max_repeat for k, a in enumerate(points)}  # the least share repeats most

    low, high = 0.0, 1.0
    for level in range(0, STEPS, LEVELS):
        width = (high - low) / (1 << LEVELS)
        inner = [low + width * k for k in range(1, 1 << LEVELS)]
        up = measure(inner if level else [0.0, *inner, 1.0])
        if not level and min_entropy is not None and up[1.0]:
            return 1.0
        if not level and min_entropy is None and not up[0.0]:
            return 0.0
        for _ in range(LEVELS):
            middle = (low + high) / 2
            low, high = (middle, high) if up[middle] else (low, middle)
    return low if min_entropy is not None else high


def source_weights(tokens: DataFrame, budget_ratio: float, max_repeat: float | None, min_entropy: float | None) -> DataFrame:
    """Per source: n_docs, tokens, exponent, weight (9 digits), budget in tokens. tokens: src, n. Sources without tokens have weight 0."""
    sources = cut(tokens.groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(max(total, 1))).alias("p"))
    a = exponent(shares, budget_ratio, max_repeat, min_entropy) if total else 1.0
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.round(F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(a)) / F.lit(z), 9)).otherwise(F.lit(0.0))
    return sources.select("src", "n_docs", "tokens", F.lit(a).alias("exponent"), weight.alias("weight"), F.floor(weight * F.lit(total) * F.lit(float(budget_ratio))).cast("long").alias("budget"))


def mixing_plan(tokens: DataFrame, seed: int, budget_ratio: float, max_repeat: float | None, min_entropy: float | None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per source with a budget: src, n_blocks, full (whole epochs), cut_hash, cut_block, cut_doc (where the last epoch ends), epochs
    (their number with its fraction). tokens: doc_id, src, n."""
    weights = cut(source_weights(tokens, budget_ratio, max_repeat, min_entropy)).where("budget > 0")
    full = F.expr("budget div tokens")
    sources = weights.select("src", "tokens", F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n_docs") / block_docs)).cast("long").alias("n_blocks"), full.alias("full"), (F.col("budget") - full * F.col("tokens")).alias("rest"))
    dealt = with_source(tokens, sources).withColumn("block", block_of(seed))
    totals = dealt.groupBy("src", "block").agg(F.sum("n").alias("n"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    totals = totals.withColumn("h", _hash(F.lit(seed), F.col("full"), F.col("src"), F.col("block")))
    order = Window.partitionBy("src").orderBy("h", "block")
    # the first block that goes beyond what is left of the budget
    ends = totals.withColumn("before", F.sum("n").over(order) - F.col("n")).where("before <= rest AND before + n > rest AND rest > 0")
    ends = cut(ends.select("src", F.col("block").alias("cut_block"), F.col("h").alias("cut_hash"), (F.col("rest") - F.col("before")).alias("left")))
    last = dealt.select("doc_id", "src", "n", "block").join(_small(ends), ["src"]).where("block = cut_block")
    docs = last.groupBy("src", doc_hash(seed).alias("d")).agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    docs = docs.withColumn("upto", F.sum("n").over(Window.partitionBy("src").orderBy("d"))).where("upto <= left")
    docs = docs.groupBy("src").agg(F.max("d").alias("cut_doc"))
    plan = sources.join(ends, "src", "left").join(docs, "src", "left")
    epochs = F.col("full") + F.when(F.col("rest") > 0, _fraction(F.col("cut_hash"))).otherwise(F.lit(0.0))
    return cut(plan.select("src", "n_blocks", "full", "rest", "cut_hash", "cut_block", F.coalesce("cut_doc", F.lit("")).alias("cut_doc"), epochs.alias("epochs")))


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(_small(sources), "src")


def block_of(seed: int) -> Column:
    h = _hash(F.lit(seed), F.lit("block"), F.col("doc_id"))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.col("n_blocks"))


def doc_hash(seed: int) -> Column:
    return _hash(F.lit(seed), F.lit("doc"), F.col("doc_id"))


def mix(documents: DataFrame, seed: int = 7, budget_ratio: float = 1.0, max_repeat: float | None = 1.25, min_entropy: float | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The mixture: documents' rows, each as often as its source's budget takes it, with mix_* columns.

    documents: doc_id, text, source; all their columns are kept, but mix_* ones are
    replaced. The budget is ``budget_ratio`` times the corpus's
    tokens (words); give ``max_repeat`` or ``min_entropy``. mix_epoch counts a row's copies from 0; mix_block is its block; ordering
    by mix_order (0 to 1) gives each prefix the target weights, up to whole blocks. A source's rows take up at most its budget and lack less than a
    document of it. A null source is the source ''; a null or empty text has no tokens and goes with its block; rows that share a
    doc_id go together. A source without tokens has no rows. An empty table gives none.
    """
    if (max_repeat is None) == (min_entropy is None):
        raise ValueError("give either max_repeat or min_entropy")
    rows = documents.select(
        F.struct(*(c for c in documents.columns if c not in MIX_COLUMNS)).alias("row"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n"),
    )
    plan = mixing_plan(written(rows.select("doc_id", "src", "n"), "mixing"), seed, budget_ratio, max_repeat, min_entropy, block_docs)
    rows = with_source(rows, plan).withColumn("block", block_of(seed))
    partial = _hash(F.lit(seed), F.col("full"), F.col("src"), F.col("block"))
    taken = (F.col("rest") > 0) & (
        (partial < F.col("cut_hash")) | ((partial == F.col("cut_hash")) & (F.col("block") < F.col("cut_block"))) | ((F.col("block") == F.col("cut_block")) & (doc_hash(seed) <= F.col("cut_doc")))
    )
    copies = F.col("full") + taken.cast("long")
    rows = rows.withColumn("copies", copies).where("copies > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))
    at = _fraction(_hash(F.lit(seed), F.col("epoch"), F.col("src"), F.col("block")))
    order = F.least(F.lit(1.0), (F.col("epoch") + at) / F.greatest(F.col("epochs"), F.col("epoch") + at))
    return rows.select("row.*", F.col("n").alias("mix_tokens"), F.col("epoch").alias("mix_epoch"), F.col("block").alias("mix_block"), F.round(order, 9).alias("mix_order"))
