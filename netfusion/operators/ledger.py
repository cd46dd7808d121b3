"""A hash-chained evidence ledger: Merkle roots per block, blocks chained by their hashes, verification against all leaves."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netfusion.operators.ranking import ranked

EMPTY_ROOT = hashlib.sha256(b"EMPTY_MERKLE_TREE").hexdigest()
GENESIS = "0" * 64
DEFAULT_TIME = "2026-01-01T00:00:00+00:00"


def canonical_hash(value: object) -> str:
    """SHA-256 of a value: strings as they are, others as JSON with sorted keys."""
    if isinstance(value, bytes):
        return hashlib.sha256(value).hexdigest()
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True, default=str) if isinstance(value, dict | list) else str(value)
    return hashlib.sha256(text.encode()).hexdigest()


def record_hashes(records: DataFrame, *keep: str) -> DataFrame:
    """keep and leaf: a record's own evidence_hash if it has one, else the hash of its canonical JSON (an Arrow-batched function, as
    built-in JSON has other separators and order)."""
    fields = [c for c in records.columns if c not in keep]

    @F.pandas_udf("string")
    def digest(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([canonical_hash({k: (v.item() if hasattr(v, "item") else v) for k, v in r.items()}) for r in rows.to_dict("records")])

    own = F.when(F.coalesce(F.col("evidence_hash"), F.lit("")) != "", F.col("evidence_hash")) if "evidence_hash" in fields else F.lit(None).cast("string")
    return records.select(*keep, F.coalesce(own, digest(F.struct(*fields))).alias("leaf"))


def full_hash(leaf: Column) -> Column:
    """Leaves that aren't 64 hex digits are hashed again."""
    return F.when(F.length(leaf) == 64, leaf).otherwise(F.sha2(leaf, 256))


FOLD = 10  # levels that one aggregation folds


def _fold(hashes: Column, whole: Column) -> Column:
    """FOLD levels of pairing neighbours, an odd last one with itself; a ``whole`` tree stops at its root."""
    pair = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: F.sha2(F.concat(F.get(a, 2 * i), F.coalesce(F.get(a, 2 * i + 1), F.get(a, 2 * i))), 256))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FOLD)), hashes, lambda a, _: F.when(whole & (F.size(a) == 1), a).otherwise(pair(a)))


def numbered_leaves(leaves: DataFrame, *order: str) -> DataFrame:
    """block, seq (0 on in each block, by ``order``), leaf. All leaves are numbered at once over ranges, and each block's first number is
    taken off, so a block of any size is spread over tasks."""
    numbered = ranked(leaves, "block", *order, name="_n")
    first = numbered.groupBy("block").agg(F.min("_n").alias("_first"))
    return numbered.join(first, "block").select("block", (F.col("_n") - F.col("_first")).alias("seq"), "leaf")


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """block, n_leaves, root. leaves: block, seq (0 on without gaps), leaf. Groups of 1024 neighbours are folded in parallel, so a block of
    any size takes a round for each ten levels."""
    sizes = leaves.groupBy("block").agg(F.count("*").alias("n_leaves"))
    level = leaves.select("block", F.col("seq").cast("long").alias("i"), full_hash(F.col("leaf")).alias("h"))
    width = sizes.agg(F.max("n_leaves")).first()[0] or 0
    counts = sizes.select("block", F.col("n_leaves").alias("n"))
    while width:
        chunk = F.shiftright("i", FOLD).alias("c")
        parts = level.groupBy("block", chunk).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("p")).join(counts, "block")
        folded = _fold(F.transform("p", lambda x: x["h"]), F.col("n") <= (1 << FOLD))
        level = parts.select("block", F.col("c").alias("i"), folded[0].alias("h"))
        counts = counts.select("block", F.ceil(F.col("n") / (1 << FOLD)).alias("n"))
        width = -(-width >> FOLD) if width > 1 << FOLD else 0
    return sizes.join(level.select("block", F.col("h").alias("root")), "block")


def chain(blocks: Sequence[tuple[str, str]], officer: str = "Investigating Officer", timestamp: str = DEFAULT_TIME, genesis: str = GENESIS) -> list[dict]:
    """Chained blocks from (name, merkle root) in order: a fold over the few blocks of a ledger."""
    out, previous = [], genesis
    for i, (name, root) in enumerate(blocks):
        digest = canonical_hash(f"{i}:{name}:{previous}:{root}:{timestamp}:{officer}")
        out.append({"index": i, "block_name": name, "previous_hash": previous, "merkle_root": root, "block_hash": digest, "timestamp": timestamp, "officer": officer})
        previous = digest
    return out


def chain_valid(blocks: DataFrame) -> DataFrame:
    """valid: every previous_hash is the block before's hash."""
    before = F.lag("block_hash").over(Window.orderBy("index"))
    links = blocks.select(F.coalesce(F.col("previous_hash") == before, F.lit(True)).alias("ok"))
    return links.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("valid"))


def certificate(blocks: DataFrame, leaves: DataFrame, case_name: str, issued: str, officer: str = "Investigating Officer", station: str = "") -> DataFrame:
    """One row that certifies a ledger: certificate_id, ledger_id, case_name, issued, officer, station, master_root (the Merkle root of the
    blocks' hashes), n_blocks, n_records, chain_valid, declaration and token, the hash of id, root and time."""
    order = blocks.select(F.lit(0).alias("block"), F.col("index").cast("long").alias("seq"), F.col("block_hash").alias("leaf"))
    master = merkle_roots(order).select(F.col("root").alias("master_root"))
    n = blocks.agg(F.count("*").alias("n_blocks")).join(leaves.agg(F.count("*").alias("n_records"))).join(chain_valid(blocks).select(F.col("valid").alias("chain_valid")))
    one = n.join(master, how="left").withColumn("master_root", F.coalesce("master_root", F.lit(EMPTY_ROOT)))
    one = one.withColumn("certificate_id", F.concat(F.lit("CERT-BSA63-"), F.upper(F.substring("master_root", 1, 12))))
    ledger_id = F.concat(F.lit("LEDGER-NCRB-"), F.upper(F.substring(F.sha2(F.lit(case_name), 256), 1, 12)))
    declaration = F.concat(F.lit("The records of this ledger were hashed when they were read; by the master root "), "master_root", F.lit(" none was altered, added or deleted since."))
    token = F.sha2(F.concat_ws(":", "certificate_id", "master_root", F.lit(issued)), 256)
    return one.select(
        "certificate_id", ledger_id.alias("ledger_id"), F.lit(case_name).alias("case_name"), F.lit(issued).alias("issued"), F.lit(officer).alias("officer"), F.lit(station).alias("station"),
        "master_root", "n_blocks", "n_records", "chain_valid", declaration.alias("declaration"), token.alias("token"),
    )


def verify(leaves: DataFrame, blocks: DataFrame, digest: str) -> DataFrame:
    """matched_in, name: where a hash (or a prefix of 8 digits or more) is a block's hash, a Merkle root or any leaf."""
    prefix = digest.lower()
    if len(prefix) < 8:
        raise ValueError("give 8 hex digits or more")
    hit = lambda c: F.lower(c).startswith(prefix)
    of = lambda kind, df, name, c: df.where(hit(F.col(c))).select(F.lit(kind).alias("matched_in"), F.col(name).cast("string").alias("name"))
    return of("block", blocks, "block_name", "block_hash").union(of("merkle_root", blocks, "block_name", "merkle_root")).union(of("leaf", leaves, "block", "leaf"))
