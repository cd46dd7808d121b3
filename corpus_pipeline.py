"""A corpus pipeline from documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written as Parquet and
read back as the next one's docs. All but the last return the columns of documents.

In every stage an empty table gives an empty one; other columns than doc_id and text (and source, in mixing) are carried along, whatever
their names; texts are processed whole, whatever their length. What a stage makes of nulls, empty texts, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from netfusion.llm.common import partitions, table, written
from netfusion.llm.decontam import decontaminate
from netfusion.llm.mixing import mix
from netfusion.llm.quality import keep_good
from netfusion.llm.simhash import keep_one
from netfusion.llm.tokens import read_tokens, write_tokens

#: The trained classifier and the order of rows have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier, fitted on labels, rejects (a score below its threshold; a score equal to it stays).

    A null text is judged as an empty one; rows without doc_id and repeated rows are judged each by their text.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of SimHash near-duplicates the document with the least id.

    Null and empty texts are near each other and texts without words. Rows that repeat a doc_id are one document, of which one stays;
    rows without doc_id all stay.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item.

    Null and empty texts contain none and stay; rows without doc_id and repeated rows are judged each. A containment of exactly 0.8 drops.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's rows as often as its weight says: a budget of as many tokens as there are, none repeated over 1.25 times.

    Rows come in the order of the mixture, so the files written from them are in it: first by mix_order, then, of a block, by doc_id. A null
    source is one of its own; null and empty texts have no tokens and go with their block; rows that share a doc_id go together, one
    without doc_id too. A source without tokens has no rows.
    """
    # the row goes as a struct, as it may have columns named like those that say the order
    held = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source")
    mixed = mix(held).select("_row", "mix_order", "mix_epoch", "mix_block", "doc_id")
    order = ("mix_order", "mix_epoch", "mix_block", "doc_id")
    return mixed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("_row.*")


def in_file_order(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with columns that say the order of its files' rows, and their names; by doc_id if it doesn't come from files."""
    try:
        name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        part = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")
        return docs.select("doc_id", "text", part.alias("_part"), name.alias("_file"), row.alias("_place")), ("_part", "_file", "_place")
    except AnalysisException:
        return docs, ("doc_id",)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids bit-packed, documents in the order of the stage before, and returns each row's place in them, read from the files.

    Null and empty texts give the end id alone; repeated rows are written each; a null doc_id stays null.
    """
    import public_tokenizers

    rows, order = in_file_order(docs)
    return read_tokens(write_tokens(rows, public_tokenizers.path("word_bpe_49k.json"), order=order))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
