"""Entity resolution: mentions of people to directory ids.

mentions: seq, value, confidence, phone, evidence_snippet, source_id, source_type; people: id, name, cell, phone, account, address, org, ordinal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netfusion.functions.similarity import best_of_known, character_counts, known_names, name_similarity, partial_similarity, upper_bounds
from netfusion.functions.text import initials_score
from netfusion.session import cut

MERGE, REJECT, LEAST_CONFIDENCE = 85.0, 70.0, 0.65
#: Values and names that meet in one row.
VALUE_BLOCK, NAME_BLOCK = 1024, 4096


def _normal(c: str) -> Column:
    return F.lower(F.trim(c))


def _signature(c: str) -> Column:
    """The characters of a name, in order: names that share it share their bounds."""
    return F.array_join(F.array_sort(F.split(_normal(c), "")), "")


def _blocks(rows: DataFrame, most: int, name: str, *columns: str) -> tuple[DataFrame, int]:
    """(block, list) of about ``most`` rows (key, ...) each, dealt by a hash of the key, and how many blocks there are."""
    blocks = max(1, -(-rows.count() // most))
    dealt = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias(f"{name}_block"))
    return dealt.agg(F.collect_list(F.struct(*columns)).alias(name)), blocks


def _sorted_join(left: DataFrame, right: DataFrame, on: Column | str, how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side, however small its files look: a directory's names would go through the driver."""
    return left.hint("merge").join(right, on, how)


def candidates(mentions: DataFrame, people: DataFrame, least: float = REJECT) -> DataFrame:
    """value, id, name, ordinal: pairs among which is, for each value with a name that scores ``least`` or more, the best name in the order of
    best_candidates().

    Equal names and pairs by initials come from joins on words. For the rest, blocks of values meet blocks of names, those of the same characters
    together; there each pair has an upper bound of its score from the characters that both hold, whatever their order (no common subsequence
    has more). A value is first scored with the names of its greatest bound, which gives what it reaches; then names are scored
    from the highest bound down until none can reach the best. No pair is left out for the size of either side.
    """
    names = people.select("id", "name", "ordinal").where("name IS NOT NULL")
    values = mentions.select("value").where("value IS NOT NULL").distinct()
    exact = _sorted_join(values, names, _normal("value") == _normal("name"))
    rest = cut(_sorted_join(values, exact.select("value"), "value", "left_anti"))
    return exact.select("value", "id", "name", "ordinal").unionByName(_by_initials(rest, names)).unionByName(_by_bounds(rest, names, least))


def _by_initials(values: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of which initials_score() may be over 0: two words, one equal and of the other the initial."""
    m = F.split(F.trim(F.lower(F.regexp_replace("value", r"[.\s]+", " "))), " ")
    n = F.split(F.trim(F.lower(F.regexp_replace("name", r"\s+", " "))), " ")
    key = lambda words, k: F.struct(F.lit(k).alias("at"), F.get(words, 1 - k).alias("word"), F.substring(F.get(words, k), 1, 1).alias("initial"))
    asked = F.array_compact(F.array(*[F.when(F.length(F.get(m, k)) == 1, key(m, k)) for k in (0, 1)]))
    v = values.where(F.size(m) == 2).select("value", F.explode(asked).alias("key"))
    known = names.where(F.size(n) == 2).select("id", "name", "ordinal", F.explode(F.array(key(n, 0), key(n, 1))).alias("key"))
    return _sorted_join(v, known, "key").select("value", "id", "name", "ordinal")


def _meets(values: DataFrame, names: DataFrame, of_value: tuple, of_name: tuple, run: Callable, schema: str) -> DataFrame:
    """What run(values, names, names' block) yields for each block of values and each of names; a block of names comes many times in a row."""
    listed, _ = _blocks(values, VALUE_BLOCK, "values", *of_value)
    known, n = _blocks(names, NAME_BLOCK, "names", *of_name)
    meets = _sorted_join(listed.select("values", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("names_block")), known, "names_block")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = {}, None
        for batch in batches:
            for some, others, k in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if k != last:
                    held, last = {}, k
                yield run(some.as_py(), others, held)

    return meets.select("values", "names", "names_block").mapInArrow(every, schema)


def _floors(values: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """key, value, least: values (key, value) with the best score among the names whose characters promise most, or ``least`` if it is more."""
    one = lambda rows, c: rows.groupBy("key").agg(F.min(c).alias(c))

    def promise(some: list, others: pa.Scalar, held: dict) -> pa.RecordBatch:
        import numpy as np

        if not held:
            rows = others.as_py()
            low = [r["name"].strip().lower() for r in rows]
            held |= {"keys": [r["key"] for r in rows], "counts": character_counts(low), "sizes": np.array([len(x) for x in low])}
        own = [r["value"].strip().lower() for r in some]
        bounds, at = [], []
        for counts, x in zip(character_counts(own), own, strict=True):
            bound = upper_bounds(counts, len(x), held["counts"], held["sizes"])[0]
            at.append(int(bound.argmax()))
            bounds.append(float(bound[at[-1]]))
        return pa.RecordBatch.from_arrays([pa.array([r["key"] for r in some], pa.string()), pa.array(bounds, pa.float64()), pa.array([held["keys"][k] for k in at], pa.string())], names=["key", "bound", "near"])

    promised = _meets(one(values, "value"), one(names, "name"), ("key", "value"), ("key", "name"), promise, "key string, bound double, near string")
    best = promised.groupBy("key").agg(F.max_by("near", F.struct("bound", "near")).alias("near"))
    listed = values.groupBy("key").agg(F.collect_list("value").alias("values"))
    known = names.groupBy(F.col("key").alias("near")).agg(F.collect_list("name").alias("names"))
    meets = _sorted_join(_sorted_join(listed, best, "key"), known, "near").select("key", "values", "names")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, some, others in zip(*batch.columns, strict=True):
                values_ = some.as_py()
                score = {v: s for v, _, s in best_of_known(values_, known_names(others.as_py()), [least] * len(values_))}
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(values_), pa.string()), pa.array(values_, pa.string()), pa.array([score.get(v, least) for v in values_], pa.float64())], names=["key", "value", "least"])

    return cut(meets.mapInArrow(reached, "key string, value string, least double"))


def _by_bounds(values: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """The best name of each value in each block of names, if it scores ``least`` or more by ratio or partial ratio, and no less than the value is
    known to reach with some name. Of equal names only the first is looked at."""
    kinds = {f.name: f.dataType for f in names.schema.fields}
    first = names.groupBy("name").agg(F.min(F.struct("ordinal", "id")).alias("b")).select("b.id", "name", "b.ordinal")
    first = cut(first.withColumn("key", _signature("name")))
    floors = _floors(values.withColumn("key", _signature("value")), first, least)

    def bests(some: list, others: pa.Scalar, held: dict) -> pa.RecordBatch:
        if not held:
            rows = sorted(others.as_py(), key=lambda r: (r["ordinal"] is not None, r["ordinal"], r["id"]))
            held |= {"rows": rows, "known": known_names([r["name"] for r in rows])}
        fields = others.values.type
        picked = [(v, held["rows"][k]) for v, k, _ in best_of_known([r["value"] for r in some], held["known"], [r["least"] for r in some])]
        columns = [pa.array([v for v, _ in picked], pa.string())] + [pa.array([r[c] for _, r in picked], fields.field(c).type) for c in ("id", "name", "ordinal")]
        return pa.RecordBatch.from_arrays(columns, names=["value", "id", "name", "ordinal"])

    schema = "value string, " + ", ".join(f"{c} {kinds[c].simpleString()}" for c in ("id", "name", "ordinal"))
    return _meets(floors, first, ("value", "least"), ("id", "name", "ordinal"), bests, schema)


def scored(pairs: DataFrame) -> DataFrame:
    """name_score: 100 for equal names (without case), else the greater of ratio and 0.95 * partial ratio, or 92 by initials if greater."""
    exact = F.lower(F.trim("value")) == F.lower(F.trim("name"))
    s = pairs.withColumns({"ratio": name_similarity(F.col("value"), F.col("name")), "partial": partial_similarity(F.col("value"), F.col("name"))})
    best = F.greatest("ratio", 0.95 * F.col("partial"), initials_score(F.col("value"), F.col("name")))
    return s.select("value", "id", "name", "ordinal", "partial", F.when(exact, 100.0).otherwise(best).alias("name_score"), F.when(exact, "exact").otherwise("fuzzy").alias("method"))


def best_candidates(scores: DataFrame) -> DataFrame:
    """The best name of each value, the first in directory order on ties; aggregated, so a common value needs no sort. After candidates() a
    value without a name that scores REJECT or more has no row, or one that scores less."""
    order = F.struct((-F.col("name_score")).alias("s"), "ordinal", "id")
    return scores.groupBy("value").agg(F.min_by(F.struct("id", "name", "partial", "name_score", "method"), order).alias("b")).select("value", "b.*")


def confidence(name_score: Column, phone: Column, context: Column) -> Column:
    return F.round(F.least(F.lit(1.0), name_score / 100 + 0.04 * phone + 0.02 * context), 3)


def context_signal(snippet: Column, address: Column, org: Column, cell: Column) -> Column:
    """0.5; 1 if a token of the address (over three letters) or the organisation is in the snippet; 0.8 if the cell's id is."""
    low = F.lower(F.coalesce(snippet, F.lit("")))
    has = lambda x: F.contains(low, F.lower(x)) & (F.coalesce(x, F.lit("")) != "")
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), F.trim), lambda t: F.length(t) > 3)
    near = F.exists(parts, lambda t: F.contains(low, F.lower(t))) | F.coalesce(has(org), F.lit(False))
    return F.when(near, 1.0).when(F.coalesce(has(cell), F.lit(False)), 0.8).otherwise(0.5)


def resolve(mentions: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The map (mention, canonical) and the log of merges and rejects. A value is judged once, by its first mention (least seq)."""
    first = Window.partitionBy("value").orderBy("seq")
    once = mentions.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    best = best_candidates(scored(candidates(mentions, people)))
    facts = people.select("id", *(F.col(c).alias(f"p_{c}") for c in ("phone", "account", "address", "org", "cell")))
    t = _sorted_join(_sorted_join(once, best, "value", "left"), facts, "id", "left")
    text = F.coalesce("evidence_snippet", F.lit(""))
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    phone = F.when(known("phone") & (F.col("phone") == F.col("p_phone")), 1.0).when((known("p_phone") & F.contains(text, F.col("p_phone"))) | (known("p_account") & F.contains(text, F.col("p_account"))), 1.0).otherwise(0.0)
    t = t.withColumns({"phone_score": phone, "context_score": context_signal(F.col("evidence_snippet"), F.col("p_address"), F.col("p_org"), F.col("p_cell"))})
    single = ~F.contains(F.trim("value"), F.lit(" ")) & (F.col("partial") > MERGE)
    t = t.withColumn("conf", confidence(F.when(single, F.greatest("name_score", "partial")).otherwise(F.col("name_score")), F.col("phone_score"), F.col("context_score")))
    merged = (F.col("name_score") >= MERGE) & (F.col("conf") >= LEAST_CONFIDENCE)
    judged = t.withColumn("method", F.when(F.coalesce(merged, F.lit(False)), F.col("method")).when(F.col("name_score") >= REJECT, "fuzzy_reject"))
    canonical = F.when(F.col("method").isin("exact", "fuzzy"), F.col("id").cast("string")).otherwise(F.col("value"))
    log = judged.where("method IS NOT NULL").select(
        F.when(F.col("method") == "fuzzy_reject", F.col("value")).otherwise(F.col("id").cast("string")).alias("master_id"), F.col("value").alias("merged_ids"), "method",
        F.when(F.col("method") == "fuzzy_reject", 0.5).otherwise(F.col("conf")).alias("confidence"), F.round("name_score", 1).alias("name_score"), "phone_score", "context_score", "source_id", "source_type", "evidence_snippet",
        F.substring(F.sha2(text, 256), 1, 16).alias("evidence_hash"),
    )
    return judged.select(F.col("value").alias("mention"), canonical.alias("canonical")), log


def history_context(history: DataFrame, order: str) -> DataFrame:
    """person_id, address and org of each person in history (person_id, known_address, gang_affiliation): of each the last value that isn't
    empty, by ``order``, whatever row it is in; null if all are."""
    last = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col(order)))
    some = lambda c: F.max(F.coalesce(c, F.lit("")) != "")
    return history.groupBy("person_id").agg(F.when(some("known_address"), last("known_address")).alias("address"), F.when(some("gang_affiliation"), last("gang_affiliation")).alias("org"))
