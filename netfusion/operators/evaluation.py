"""Checks of results against ground truth, which no operator reads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _status(found: Column, total: Column) -> Column:
    return F.when(found >= total, "PASS").when(found > 0, "PARTIAL").otherwise("FAIL")


def recovered(name: str, expected: DataFrame, found: DataFrame, partial: float = 0.0) -> DataFrame:
    """check, found, total, status: how many of the expected ids (id) are among found (id); PARTIAL from a share over ``partial``."""
    hit = expected.select("id").distinct().join(found.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    t = hit.agg(F.count("_hit").alias("found"), F.count("*").alias("total"))
    status = F.when(F.col("found") / F.greatest(F.col("total"), F.lit(1)) < partial, "FAIL").otherwise(_status(F.col("found"), F.col("total")))
    return t.select(F.lit(name).alias("check"), "found", "total", status.alias("status"))


def event_coverage(name: str, bursts: DataFrame, days: Iterable[int], within: int = 2) -> DataFrame:
    """The same for events: days that have a burst within ``within`` days."""
    wanted = bursts.sparkSession.createDataFrame([(d,) for d in days], "day int")
    near = F.broadcast(wanted).join(bursts.select(F.col("day").alias("b")).distinct(), F.abs(F.col("b") - F.col("day")) <= within).select("day").distinct()
    return recovered(name, wanted.select(F.col("day").alias("id")), near.select(F.col("day").alias("id")))


def flag_hygiene(flag: str, **tables: DataFrame) -> DataFrame:
    """FAIL if a table has the evaluation column."""
    bad = [n for n, df in tables.items() if flag in df.columns]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([("flag_hygiene", len(tables) - len(bad), len(tables), "FAIL" if bad else "PASS")], "check string, found long, total long, status string")


def alias_recovery(log: DataFrame, aliases: DataFrame, people: DataFrame, partial: float = 0.5) -> DataFrame:
    """Aliases (alias, canonical: a name) that some value merged into the name's id contains; PARTIAL from half of them. log: master_id, merged_ids."""
    wanted = aliases.join(people.select(F.col("name").alias("canonical"), F.col("id").cast("string").alias("master_id")), "canonical", "left")
    met = wanted.join(log.select("master_id", "merged_ids"), "master_id").where(F.contains("merged_ids", "alias"))
    return recovered("alias_recovery", aliases.select(F.col("alias").alias("id")), met.select(F.col("alias").alias("id")), partial)


def structuring_check(fans: DataFrame, receiver: object, least_small: int = 10, least_lumps: int = 2) -> DataFrame:
    """PASS if the receiver is flagged with so many small receipts and consolidations, PARTIAL if it is flagged with fewer."""
    own = fans.where(F.col("receiver") == F.lit(receiver)).agg(F.max("cash_small_count").alias("small"), F.max(F.size("consolidations")).alias("lumps"))
    enough = (F.col("small") >= least_small) & (F.col("lumps") >= least_lumps)
    found = F.when(F.col("small").isNull(), 0).when(enough, 2).otherwise(1).cast("long")
    return own.select(F.lit("structuring").alias("check"), found.alias("found"), F.lit(2).cast("long").alias("total"), _status(found, F.lit(2)).alias("status"))


def gate(*checks: DataFrame) -> DataFrame:
    """The checks and a row ``overall``: FAIL if one fails, else PARTIAL if one is partial, else PASS; found counts those that pass."""
    every = checks[0]
    for more in checks[1:]:
        every = every.unionByName(more)
    n = lambda s: F.count_if(F.col("status") == s)
    overall = every.agg(n("PASS").alias("found"), F.count("*").alias("total"), n("FAIL").alias("bad"), n("PARTIAL").alias("half"))
    status = F.when(F.col("bad") > 0, "FAIL").when(F.col("half") > 0, "PARTIAL").otherwise("PASS")
    return every.unionByName(overall.select(F.lit("overall").alias("check"), "found", "total", status.alias("status")))


def precision_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """precision and recall of ids (id) to 6 digits; an empty side gives 0."""
    p, t = predicted.select("id").distinct().withColumn("p", F.lit(1)), truth.select("id").distinct().withColumn("t", F.lit(1))
    n = p.join(t, "id", "full").agg(F.count("p").alias("p"), F.count("t").alias("t"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("b"))
    share = lambda c: F.round(F.when(F.col(c) > 0, F.col("b") / F.col(c)).otherwise(0.0), 6)
    return n.select(share("p").alias("precision"), share("t").alias("recall"))
