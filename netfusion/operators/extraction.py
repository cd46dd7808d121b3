"""Entities and relations from text. texts: doc_id, text, source_type, day."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfusion.functions.text import LOCATIONS, PATTERNS, evidence_hash, relation_kind, snippet

#: Words that begin boilerplate, not names.
STOP_WORDS = (
    "Police", "Station", "Team", "Unit", "Complaint", "Shopkeeper", "Missing", "Traffic", "Package", "Meeting", "Collections", "Hustle", "Grind", "Biryani", "Sunset",
    "Cricket", "Electrician", "Act", "Section", "IPC", "FIR", "Informant", "Source", "Complainant", "Surveillance",
)
#: Patterns of two or three capitalised words and of one.
NAME = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,2}\b"
WORD = r"\b[A-Z][a-z]{2,}\b"


def pattern_entities(texts: DataFrame, patterns: dict[str, str] = PATTERNS, confidence: float = 0.95) -> DataFrame:
    """doc_id, source_type, day, entity_type, value, n, confidence, evidence_snippet, evidence_hash: each different match of a text, with the
    number of its occurrences and the snippet around the first."""
    kinds = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)).alias("found")) for k, p in patterns.items()])
    hits = texts.where(F.col("text").rlike("|".join(patterns.values()))).select("doc_id", "source_type", "day", "text", F.explode(kinds).alias("k"))
    hits = hits.select("doc_id", "source_type", "day", "text", "k.entity_type", "k.found", F.explode(F.array_distinct("k.found")).alias("value"))
    snip = snippet(F.col("text"), F.expr("locate(value, text)"), F.length("value"))
    out = hits.select("doc_id", "source_type", "day", "entity_type", "value", F.size(F.filter("found", lambda x: x == F.col("value"))).alias("n"), F.lit(confidence).alias("confidence"), snip.alias("evidence_snippet"))
    return out.select("*", evidence_hash(F.col("evidence_snippet")).alias("evidence_hash"))


def gazetteer_entities(texts: DataFrame, names: Sequence[str] = LOCATIONS, entity_type: str = "Location", confidence: float = 0.85) -> DataFrame:
    """The same for literal names; each name that a text contains counts once."""
    hits = texts.select("doc_id", "source_type", "day", "text", F.explode(F.filter(F.array(*map(F.lit, names)), lambda x: F.contains(F.col("text"), x))).alias("value"))
    snip = snippet(F.col("text"), F.expr("locate(value, text)"), F.length("value"))
    out = hits.select("doc_id", "source_type", "day", F.lit(entity_type).alias("entity_type"), "value", F.lit(1).alias("n"), F.lit(confidence).alias("confidence"), snip.alias("evidence_snippet"))
    return out.select("*", evidence_hash(F.col("evidence_snippet")).alias("evidence_hash"))


def sentences(texts: DataFrame) -> DataFrame:
    return texts.where("text IS NOT NULL").select("doc_id", "source_type", "day", F.posexplode(F.split("text", r"[.!?]\s+")).alias("seq", "sentence"))


def name_mentions(texts: DataFrame, first_names: DataFrame | None = None, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """doc_id, source_type, day, seq, value, confidence, evidence_snippet, evidence_hash, extractor of names written in capitals.

    Two or three capitalised words (4 to 35 characters, no stop word inside) have 0.45; a single one that is a known first name (first_names:
    name, lower case) and in no such run of its sentence 0.40. First names are few beside texts and joined by Spark's own choice.
    """
    s = sentences(texts).withColumn("caps", F.regexp_extract_all("sentence", F.lit(f"({NAME})"), F.lit(1)))
    evidence = F.replace(F.substring(F.trim("sentence"), 1, 120), F.lit("\n"), F.lit(" "))
    bad = lambda x: F.exists(F.array(*map(F.lit, stop_words)), lambda w: F.contains(x, w))
    multi = s.select("doc_id", "source_type", "day", "seq", F.explode("caps").alias("value"), F.lit(0.45).alias("confidence"), evidence.alias("evidence_snippet"), F.lit("fallback_two_word").alias("extractor"))
    multi = multi.where(~bad(F.col("value")) & F.length("value").between(4, 35))
    if first_names is not None:
        one = s.select("doc_id", "source_type", "day", "seq", "caps", F.explode(F.regexp_extract_all("sentence", F.lit(f"({WORD})"), F.lit(1))).alias("value"), evidence.alias("evidence_snippet"))
        one = one.where(~F.col("value").isin(*stop_words) & ~F.exists("caps", lambda c: F.contains(c, F.col("value"))))
        one = one.join(first_names.select(F.lower("name").alias("_n")).distinct(), F.lower("value") == F.col("_n"), "left_semi")
        multi = multi.unionByName(one.select("doc_id", "source_type", "day", "seq", "value", F.lit(0.40).alias("confidence"), "evidence_snippet", F.lit("fallback_single").alias("extractor")))
    return multi.select("*", evidence_hash(F.col("evidence_snippet")).alias("evidence_hash"))


#: What a run of capitalised words must not have to be a person.
NOT_PEOPLE = ("Police", "Station", *LOCATIONS)


def relations(texts: DataFrame, next_names: int = 2, known: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, src, dst, kind, confidence, supporting_text, evidence_hash: a sentence's first name with each of the next ``next_names``
    others, the kind by keywords.

    Names (compared without case) go in this order: those of ``known`` (name) that the sentence has as whole words, then runs of two or
    three capitalised words (under 35 characters, no places), then single ones that are the first word of a known name and of no
    name before. Without ``known`` only the runs are names.
    """
    # texts are dealt out first: a small file of them is one task's, and finding words and names costs more than reading
    spread = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    s = sentences(spread).where(F.length(F.trim("sentence")) >= 10).withColumn("_key", F.struct("doc_id", "seq"))
    runs = F.regexp_extract_all("sentence", F.lit(f"({NAME})"), F.lit(1))
    place = lambda x: F.exists(F.array(*map(F.lit, NOT_PEOPLE)), lambda w: F.contains(x, w))
    caps = F.filter(runs, lambda x: (F.length(x) < 35) & ~place(x))
    if known is None:
        s = s.withColumn("found", caps)
    else:
        low = known.select(F.lower(F.trim("name")).alias("mention"), F.trim("name").alias("name")).where("mention <> ''")
        first = low.select(F.split_part("mention", F.lit(" "), F.lit(1)).alias("mention")).distinct()
        wanted = low.select("mention", "name").unionByName(first.select("mention", F.lit(None).cast("string").alias("name")))
        hits = containment(s.select(F.col("_key").alias("doc_id"), F.lower("sentence").alias("text")), wanted.select("mention").distinct()).join(_broadcast(wanted), "mention")
        hits = hits.groupBy(F.col("doc_id").alias("_key")).agg(F.array_sort(F.collect_set("name")).alias("_full"), F.collect_set(F.when(F.col("name").isNull(), F.col("mention"))).alias("_first"))
        s = s.join(hits, "_key", "left").withColumn("_some", F.array_distinct(F.concat(F.coalesce("_full", F.array().cast("array<string>")), caps)))
        singles = F.regexp_extract_all("sentence", F.lit(f"({WORD})"), F.lit(1))
        lead = F.transform("_some", lambda x: F.split_part(x, F.lit(" "), F.lit(1)))
        s = s.withColumn("found", F.concat("_some", F.filter(singles, lambda w: F.array_contains(F.coalesce("_first", F.array().cast("array<string>")), F.lower(w)) & ~F.array_contains(lead, w))))
    fresh = lambda x, i: ~F.array_contains(F.transform(F.slice(F.col("found"), F.lit(1), i), F.lower), F.lower(x))
    s = s.withColumn("names", F.filter("found", fresh))
    # one name alone is dropped after the explosion: a condition before it would be pushed down and find all names once more in each of its parts
    pairs = s.select("doc_id", "seq", "sentence", F.get("names", 0).alias("src"), F.explode_outer(F.slice("names", 2, next_names)).alias("dst")).where("dst IS NOT NULL")
    text = F.replace(F.substring(F.trim("sentence"), 1, 200), F.lit("\n"), F.lit(" "))
    return pairs.select("doc_id", "seq", "src", "dst", relation_kind(F.col("sentence")).alias("r"), text.alias("supporting_text")).select("doc_id", "seq", "src", "dst", "r.kind", "r.confidence", "supporting_text", evidence_hash(F.col("supporting_text")).alias("evidence_hash"))


def structured_entities(people: DataFrame | None = None, calls: DataFrame | None = None, txns: DataFrame | None = None, history: DataFrame | None = None, firs: DataFrame | None = None) -> DataFrame:
    """Entities that datasets (with their own columns) name in fields: people, phones, accounts, aliases, gangs, places; blank fields name
    none. entity_type, value, canonical_id, source_id, source_type, day, confidence, evidence_snippet, evidence_hash, extractor."""
    none, parts = F.lit(None), []
    has = lambda *cs: [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in cs]

    def add(df: DataFrame, kind: str, value: str, canonical: str, source: Column, source_type: str, day: Column, conf: float, evidence: Column, extractor: str, hashed: Column | None = None) -> None:
        ok = has(value, canonical)
        parts.append(
            df.where(ok[0] & ok[1]).select(
                F.lit(kind).alias("entity_type"), F.col(value).alias("value"), F.col(canonical).alias("canonical_id"), source.cast("string").alias("source_id"), F.lit(source_type).alias("source_type"), day.cast("int").alias("day"),
                F.lit(conf).alias("confidence"), evidence.alias("evidence_snippet"), evidence_hash(evidence if hashed is None else hashed).alias("evidence_hash"), F.lit(extractor).alias("extractor"),
            )
        )

    text = lambda *cs: F.concat(*(F.coalesce(c.cast("string"), F.lit("None")) for c in cs))
    c, lit = F.col, F.lit
    if people is not None:
        own = lit("people_directory")
        add(people, "Person", "name", "id", own, "people_directory", none, 1.0, text(lit("people_directory:"), c("id"), lit(" "), c("name")), "canonical", c("name"))
        add(people, "Phone", "phone", "phone", own, "people_directory", none, 1.0, c("phone"), "canonical")
        add(people, "Account", "account", "account", own, "people_directory", none, 1.0, c("account"), "canonical")
    if calls is not None:
        for s in ("caller", "callee"):
            add(calls, "Person", f"{s}_name", f"{s}_id", c("call_id"), "cdr", c("day"), 0.98, text(c("call_id"), lit(":"), c(f"{s}_name"), lit(" "), c(f"{s}_phone"), lit(" day"), c("day")), "cdr_canonical")
            add(calls, "Phone", f"{s}_phone", f"{s}_phone", c("call_id"), "cdr", c("day"), 0.98, c(f"{s}_phone"), "regex_phone")
        add(calls, "Location", "cell_tower_location", "cell_tower_location", c("call_id"), "cdr", c("day"), 0.9, c("cell_tower_location"), "tower")
    if txns is not None:
        for s in ("sender", "receiver"):
            add(txns, "Person", f"{s}_name", f"{s}_id", c("txn_id"), "transaction", c("day"), 0.98, text(c("txn_id"), lit(":"), c(f"{s}_name"), lit(" "), c(f"{s}_account"), lit(" INR"), c("amount_inr")), "txn_canonical")
            add(txns, "Account", f"{s}_account", f"{s}_account", c("txn_id"), "transaction", c("day"), 0.98, c(f"{s}_account"), "regex_account")
    if history is not None:
        h = history.select("*", *(F.coalesce(n, lit("")).alias(f"_{n}") for n in ("alias", "gang_affiliation")))
        source = (c("record_id"), "criminal_history", none)
        add(h, "Person", "name", "person_id", *source, 0.97, text(c("name"), lit(" alias:"), c("_alias"), lit(" gang:"), c("_gang_affiliation")), "criminal_history", F.concat("name", "_gang_affiliation"))
        add(h, "Person_alias", "alias", "person_id", *source, 0.6, c("alias"), "alias")
        add(h, "Location", "known_address", "known_address", *source, 0.7, c("known_address"), "address")
        add(h.where(c("_gang_affiliation") != "Unaffiliated"), "Organization", "gang_affiliation", "gang_affiliation", *source, 0.75, c("gang_affiliation"), "gang_affiliation")
    if firs is not None:
        add(firs, "Location", "location", "location", c("fir_id"), "fir", c("day"), 0.9, c("location"), "fir_location")
        add(firs, "Location", "station", "station", c("fir_id"), "fir", c("day"), 0.8, c("station"), "fir_station")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def split_confidence(entities: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Entities certain enough to stand (confidence of ``least`` or more) and those to be resolved (less, or none)."""
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    return entities.where(sure), entities.where(~sure)


def provenance(relations_: DataFrame) -> DataFrame:
    """kind, n, with_text: how many relations there are of each kind, and how many of them have supporting text."""
    return relations_.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("supporting_text"), F.lit("")) != "").alias("with_text"))


def location_edges(places: DataFrame) -> DataFrame:
    """src, dst, kind, confidence from records at places: source_type, record_id, location, confidence_label."""
    conf = F.when(F.col("source_type") == "fir", 0.9).when(F.col("confidence_label") == "High", 0.7).otherwise(0.5)
    return places.where(F.trim(F.coalesce("location", F.lit(""))) != "").select(F.col("record_id").alias("src"), F.col("location").alias("dst"), F.lit("LOCATED_AT").alias("kind"), conf.alias("confidence"))


#: Names and mentions up to this many (some megabytes) are broadcast, so that the words of texts aren't shuffled; more are joined by a shuffle.
MAX_BROADCAST_NAMES = 100_000


def _broadcast(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES else names


def containment(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, mention for every mention that a text contains as whole words.

    Mentions are looked up, not searched: a text's runs of as many words as some mention has are joined with mentions by equality, so
    no text meets a mention that it lacks. Words are runs of letters and digits; other characters part them.
    """
    clean = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    wanted = mentions.select("mention", clean(F.col("mention")).alias("key")).where("key <> ''").withColumn("n", F.size(F.split("key", " ")))
    lengths = sorted(r.n for r in wanted.select("n").distinct().collect())  # only these runs are made: a long mention costs one run at each word
    if not lengths:
        return texts.select("doc_id", F.lit(None).cast("string").alias("mention")).limit(0)
    words = texts.where("text IS NOT NULL").select("doc_id", F.split(clean(F.col("text")), " ").alias("w"))
    joined = lambda i, n: F.concat_ws(" ", *(F.get("w", i + k) for k in range(n))) if n <= 4 else F.array_join(F.slice(F.col("w"), i + 1, n), " ")
    runs = lambda n: F.col("w") if n == 1 else F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n)), lambda i: joined(i, n))
    grams = words.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*map(runs, lengths))))).alias("key"))
    return grams.join(_broadcast(wanted.select("mention", "key")), "key").select("doc_id", "mention").distinct()


def contains_pairs(texts: DataFrame, mentions: DataFrame, block: int = 100_000, lower: bool = False) -> DataFrame:
    """doc_id, mention by plain substrings, at any size: mentions go in blocks of about ``block`` into an automaton that finds all of them in
    one pass over a text. Null or empty mentions and texts match nothing; repeated rows give one."""
    import pandas as pd

    wanted = mentions.select(F.col("mention").cast("string").alias("mention")).where("mention <> ''").distinct()
    kind = texts.schema["doc_id"].dataType.simpleString()
    parts, out = max(1, -(-wanted.count() // block)), None
    for k in range(parts):
        names = [r.mention for r in wanted.where(F.pmod(F.xxhash64("mention"), F.lit(parts)) == k).collect()]
        held = texts.sparkSession.sparkContext.broadcast(names)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            import ahocorasick

            fold = str.lower if lower else str
            by: dict[str, list[str]] = {}
            for name in held.value:
                by.setdefault(fold(name), []).append(name)
            automaton = ahocorasick.Automaton()
            for key, some in by.items():
                automaton.add_word(key, some)
            automaton.make_automaton()
            for batch in batches:
                rows = [(d, m) for d, x in zip(batch["doc_id"], batch["text"], strict=True) if x and len(automaton) for m in {m for _, some in automaton.iter(fold(x)) for m in some}]
                yield pd.DataFrame(rows, columns=["doc_id", "mention"])

        found = texts.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, mention string")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def known_names(people: DataFrame) -> DataFrame:
    return people.select(F.lower(F.split_part(F.trim("name"), F.lit(" "), F.lit(1))).alias("name")).distinct()


def keyword_flags(text: Column, words: dict[str, Sequence[str]]) -> dict[str, Column]:
    """A boolean for each name: if the text has one of its words."""
    return {name: F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(F.lower(text), w)) for name, some in words.items()}
