"""Row numbers over whole tables without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfusion.session import cut


def number_rows(rows: DataFrame, name: str = "row_no") -> DataFrame:
    """``name`` from 1 in the order of partitions and of rows in them: partitions are counted first, then each numbers its own rows. The
    rows are checkpointed in between, as another run may cut partitions differently."""
    tagged = cut(rows.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    counts = {r._part: r.n for r in tagged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    start, starts = 0, []
    for p in sorted(counts):
        starts.append((p, start))
        start += counts[p]
    bases = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _base long"))
    return tagged.join(bases, "_part").withColumn(name, F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_base")


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``name`` from 1 by ``order``: rows are sorted into ranges, one for each shuffle partition, and numbered range by range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return number_rows(rows.repartitionByRange(n, *order).sortWithinPartitions(*order), name)
