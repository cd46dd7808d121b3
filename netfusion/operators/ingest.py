"""Mapping, normalising, quarantine and bootstrap of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfusion.functions.parsing import clean_duration, clean_phone, date_parts, parse_amount, parse_date, parse_timestamp, to_day
from netfusion.operators.ranking import number_rows, ranked

#: Prefixes and widths of generated ids.
GENERATED = {"cdrs": ("call_id", "GEN-CDR", 5), "transactions": ("txn_id", "GEN-TXN", 5), "firs": ("fir_id", "GEN-FIR", 4), "social_posts": ("post_id", "GEN-POST", 4), "criminal_history": ("record_id", "GEN-REC", 4), "intelligence_reports": ("report_id", "GEN-INTEL", 4), "surveillance_reports": ("report_id", "GEN-SURV", 4)}


def apply_mapping(rows: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Target columns by their sources (null where none is mapped), then all other columns as they are."""
    used = {c for c in mapping.values() if c}
    extra = [F.col(f"`{c}`") for c in rows.columns if c not in used and c not in mapping]
    return rows.select(*((F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(t) for t, c in mapping.items()), *extra)


def normalize(rows: DataFrame, dataset: str) -> DataFrame:
    """A dataset's columns, cleaned, from whatever columns there are, plus row_no. Blank cells count as missing; the first source that
    has a value gives it."""
    have = set(rows.columns)
    numbered = number_rows(rows)

    def first(*names: str, default: Column | str = "") -> Column:
        cells = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in have]
        return F.coalesce(*cells, F.lit(default) if isinstance(default, str) else default)

    none = F.lit(None).cast("string")
    key, prefix, width = GENERATED.get(dataset, ("id", "GEN-", 5))
    unknown = F.concat(F.lit("UNK"), (F.col("row_no") - 1).cast("string"))
    # dates are parsed once, in a step of their own
    born = first("dob", default=none)
    numbered = numbered.withColumns({"_when": first("timestamp", "date", default=none), "_born": born}).withColumns({"_whens": date_parts(F.col("_when")), "_borns": date_parts(F.col("_born"))})
    numbered = numbered.withColumns({"_stamp": parse_timestamp(F.col("_when"), F.col("_whens")), "_birth": parse_timestamp(F.col("_born"), F.col("_borns"))})
    stamp = F.coalesce(parse_date(F.col("_when"), F.col("_stamp")), F.lit(""))
    day = F.coalesce(first("day", default=none).try_cast("int"), to_day(F.col("_when"), stamp=F.col("_stamp")))
    new_id = F.format_string(f"{prefix}%0{width}d", F.col("row_no"))
    side = lambda s, *more: {f"{s}_id": first(f"{s}_id", s, *more, f"{s}_name", f"{s}_phone", default=unknown), f"{s}_name": first(f"{s}_name", s, *more, f"{s}_id")}
    fields: dict[str, Column]
    if dataset == "cdrs":
        fields = {key: first(key, default=new_id)} | side("caller") | {"caller_phone": clean_phone(first("caller_phone", "caller", "caller_id"))} | side("callee", "receiver") | {"callee_phone": clean_phone(first("callee_phone", "callee", "receiver", "callee_id"))}
        fields |= {"timestamp": stamp, "day": day, "call_type": first("call_type", "type", default="voice"), "duration_sec": clean_duration(first("duration_sec")), "cell_tower_location": first("cell_tower_location", "location", default="Unknown")}
    elif dataset == "transactions":
        fields = {key: first(key, default=new_id)}
        for s in ("sender", "receiver"):
            fields |= {f"{s}_id": first(f"{s}_id", f"{s}_name", default=unknown), f"{s}_name": first(f"{s}_name", f"{s}_id"), f"{s}_account": first(f"{s}_account")}
        fields |= {"amount_inr": parse_amount(first("amount_inr", "amount", default="0")), "timestamp": stamp, "day": day, "txn_type": first("txn_type", "type", default="Bank Transfer")}
    elif dataset == "firs":
        fields = {key: first(key, "report_id", default=new_id), "date": stamp, "day": day, "station": first("station"), "location": first("location"), "ipc_sections": first("ipc_sections", "crime_type")}
        fields |= {"narrative": first("narrative", "description", "text", "facts", "allegation", "incident_summary"), "accused_name": first("accused_name"), "complainant_name": first("complainant_name")}
    elif dataset == "social_posts":
        fields = {key: first(key, default=new_id), "handle": first("handle"), "person_id": first("person_id"), "timestamp": stamp, "day": day, "location_tag": first("location_tag", "location"), "post_text": first("post_text", "text", "content"), "hashtags": first("hashtags")}
    elif dataset == "criminal_history":
        person = F.format_string("GEN-P%03d", F.col("row_no"))
        fields = {key: first(key, "history_id", default=new_id), "person_id": first("person_id", "name", "alias", default=person), "name": first("name", "person_id", "alias"), "alias": first("alias"), "dob": F.coalesce(parse_date(F.col("_born"), F.col("_birth")), F.lit(""))}
        fields |= {"prior_offences": first("prior_offences", "prior_cases", "category"), "gang_affiliation": first("gang_affiliation"), "known_address": first("known_address", "location")}
    elif dataset == "intelligence_reports":
        fields = {key: first(key, default=new_id), "date": stamp, "day": day, "source_reliability": first("source_reliability"), "narrative": first("narrative", "text"), "mentioned_entity_ids": first("mentioned_entity_ids")}
    elif dataset == "surveillance_reports":
        fields = {key: first(key, "surveillance_id", default=new_id), "date": stamp, "day": day, "team": first("team"), "location": first("location"), "confidence": first("confidence"), "activity_notes": first("activity_notes", "text", "description", "notes", "details")}
    else:
        fields = {c: first(c) for c in rows.columns}
    return numbered.select(*(c.alias(n) for n, c in fields.items()), "row_no")


#: What a normalised row must have: a reason, fields of which one must be there, and the length from which it counts.
NEEDS = {
    "cdrs": (("caller_phone / caller_id", ("caller_phone", "caller_id", "caller_name"), 1), ("callee_phone / callee_id", ("callee_phone", "callee_id", "callee_name"), 1)),
    "transactions": (("sender_id / sender_account", ("sender_id", "sender_account", "sender_name"), 1), ("receiver_id / receiver_account", ("receiver_id", "receiver_account", "receiver_name"), 1)),
    "criminal_history": (("name / person_id", ("name", "person_id", "record_id", "alias"), 1),),
    "surveillance_reports": (("activity_notes", ("activity_notes", "location", "team"), 1),),
    "firs": (("narrative", ("narrative", "ipc_sections"), 2),),
    "social_posts": (("post_text", ("post_text", "handle"), 2),),
    "people_directory": (("name / id", ("name", "id", "phone"), 1),),
}


def split_quarantine(rows: DataFrame, dataset: str, source_file: str = "") -> tuple[DataFrame, DataFrame]:
    """Rows that have what they need, and quarantine rows that tell what the others lack; numbers are the file's lines (the header is 1)."""
    have = lambda c, n: F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) >= n
    lacks = []
    for reason, names, least in NEEDS.get(dataset, ()):
        ok = have(names[0], least)
        for c in names[1:]:
            ok = ok | have(c, 1)
        lacks.append(F.when(~ok, F.lit(reason)))
    tagged = rows.withColumn("_lacks", F.array_compact(F.array(*lacks)) if lacks else F.array().cast("array<string>"))
    bad = tagged.where(F.size("_lacks") > 0).select(
        (F.col("row_no") + 1).cast("int").alias("row_no"), F.lit(source_file).alias("source_file"), F.concat(F.lit("Missing/invalid required field(s): "), F.array_join("_lacks", ", ")).alias("reason"), F.lit(0.0).alias("confidence")
    )
    return tagged.where(F.size("_lacks") == 0).drop("_lacks"), bad


def observed(calls: DataFrame | None, txns: DataFrame | None) -> DataFrame:
    """kind (phone or account), value, ids and names seen with it, sorted."""
    parts = []
    for df, kind, sides in ((calls, "phone", ("caller", "callee")), (txns, "account", ("sender", "receiver"))):
        if df is not None:
            each = F.explode(F.array(*(F.struct(F.col(f"{s}_{kind}").alias("value"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_name").alias("name")) for s in sides)))
            parts.append(df.select(each.alias("e")).select(F.lit(kind).alias("kind"), "e.*"))
    seen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    seen = seen.select("kind", blank("value").alias("value"), blank("id").alias("id"), blank("name").alias("name")).where("value IS NOT NULL").distinct()
    return seen.groupBy("kind", "value").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("name")).alias("names"))


def bootstrap(people: DataFrame, calls: DataFrame | None, txns: DataFrame | None) -> DataFrame:
    """Profiles for phones and accounts that the directory lacks: id, name, role, cell, phone, account.

    A profile takes the least observed id that the directory doesn't use, joins a phone and an account seen with one id, and otherwise
    gets AUTO-001 on, skipping taken numbers. people: id, phone, account.
    """
    seen = observed(calls, txns)
    known = people.select(F.lit("phone").alias("kind"), F.col("phone").alias("value")).union(people.select(F.lit("account"), "account"))
    fresh = seen.join(known, ["kind", "value"], "left_anti")
    ids = fresh.select("kind", "value", "names", F.explode_outer(F.filter("ids", lambda i: ~i.startswith("UNK"))).alias("id"))
    taken = people.select(F.col("id").cast("string").alias("id")).distinct()
    own = ids.join(taken, "id", "left_anti").where("id IS NOT NULL").groupBy("kind", "value").agg(F.min("id").alias("id"))
    named = fresh.join(own, ["kind", "value"], "left")
    # one phone and one account for each id; what is left over is numbered
    one = named.where("id IS NOT NULL").groupBy("id").agg(F.min(F.when(F.col("kind") == "phone", F.col("value"))).alias("phone"), F.min(F.when(F.col("kind") == "account", F.col("value"))).alias("account"), F.array_min(F.flatten(F.collect_list("names"))).alias("name"))
    placed = one.select(F.lit("phone").alias("kind"), F.col("phone").alias("value")).union(one.select(F.lit("account"), "account")).where("value IS NOT NULL")
    rest = fresh.join(placed, ["kind", "value"], "left_anti")
    rest = ranked(rest, "kind", "value", name="k")  # leftovers without any id
    # the k-th gets the k-th number that no earlier run gave
    numbers = taken.where(F.col("id").rlike(r"^AUTO-\d{3,9}$")).select(F.substring("id", 6, 9).cast("long").alias("t")).distinct()
    most = rest.count() + numbers.count()
    free = ranked(people.sparkSession.range(1, most + 1).toDF("t").join(numbers, "t", "left_anti"), "t", name="k")
    auto = rest.join(free, "k").select(F.format_string("AUTO-%03d", "t").alias("id"), F.when(F.col("kind") == "phone", F.col("value")).alias("phone"), F.when(F.col("kind") == "account", F.col("value")).alias("account"), F.get("names", 0).alias("name"))
    both = one.unionByName(auto.select("id", "phone", "account", "name"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return both.select("id", F.coalesce("name", "id").alias("name"), F.lit("Unknown (auto-bootstrapped)").alias("role"), F.lit("Unknown").alias("cell"), empty("phone").alias("phone"), empty("account").alias("account"))


def normalize_record(rows: DataFrame, source: str) -> DataFrame:
    """Any dataset's rows in a common form: day and amount_inr as whole numbers (null where they are none), all else as it is, and
    _source_type and _source_id, the first id column that has a value."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    out = rows.withColumn("day", blank("day").try_cast("int") if "day" in rows.columns else F.lit(None).cast("int"))
    if "amount_inr" in rows.columns:
        out = out.withColumn("amount_inr", F.replace(blank("amount_inr"), F.lit(","), F.lit("")).try_cast("long"))
    ids = [blank(c) for c in ("call_id", "txn_id", "fir_id", "post_id", "report_id", "record_id") if c in rows.columns]
    return out.withColumns({"_source_type": F.lit(source), "_source_id": F.coalesce(*ids) if ids else F.lit(None).cast("string")})


def union_sheets(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
