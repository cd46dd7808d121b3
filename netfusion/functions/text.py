"""Evidence snippets and hashes, keyword rules, gazetteers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers that extraction recognises.
PATTERNS = {"Phone": r"70000\d{5}", "Account": r"AC0009\d{6}", "Vehicle": r"MH-DEMO-\d{4}"}
#: Known places.
LOCATIONS = (
    "Dockside Ward", "Old Market Circle", "Riverside Colony", "Industrial Estate Road", "Central Junction", "Eastgate", "Hilltop Society", "Station Road",
    "New Colony", "Warehouse District", "North Bypass", "Lakeview Chowk",
)
#: Relation kinds, confidence, and keywords of which one must occur in a sentence; the first kind that fits counts.
RELATIONS = (
    ("CALLS", 0.75, ("frequent contact", "contact to", "phone with")),
    ("MET", 0.70, ("was seen meeting", "meeting", "conferring", "observed conferring")),
    ("TRANSFERRED_TO", 0.65, ("transferred", "sent ", "paid ", "forwarded", "handed over")),
    ("WORKS_FOR", 0.65, ("works for", "employed by", "working for", "member of")),
    ("OWNS", 0.60, ("owns", "owner of", "possession of", "registered to")),
    ("ASSOCIATED_WITH", 0.65, ("possible link", "link to", "associated with", "flagged for")),
    ("ASSOCIATED_WITH", 0.60, ("was found in possession",)),
    ("TRANSACTED", 0.60, ("package changed hands",)),
)
RELATION_DEFAULT = ("ASSOCIATED_WITH", 0.55)
#: Words in prior offences that tell of violence, and of weapons.
VIOLENCE = ("murder", "302", "307", "arms", "firearm", "weapon", "extortion", "384", "assault", "violence", "threat", "392", "397")
WEAPONS = ("arms", "firearm", "weapon", "gun", "pistol")


def evidence_hash(x: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)


def snippet(text: Column, at: Column, length: Column, around: int = 30) -> Column:
    """The text around a match at 1-based ``at``: ``around`` characters on both sides, trimmed, line ends as spaces."""
    start = F.greatest(at - around, F.lit(1))
    return F.replace(F.trim(F.substring(text, start, at + length + around - start)), F.lit("\n"), F.lit(" "))


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def relation_kind(sentence: Column) -> Column:
    """struct(kind, confidence) by keyword rules."""
    low, out = F.lower(sentence), None
    value = lambda kind, conf: F.struct(F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"))
    for kind, conf, words in RELATIONS:
        hit = contains_any(low, words)
        out = F.when(hit, value(kind, conf)) if out is None else out.when(hit, value(kind, conf))
    return out.otherwise(value(*RELATION_DEFAULT))


def risk_level(offences: Column) -> Column:
    low = F.lower(F.coalesce(offences, F.lit("")))
    return F.when(contains_any(low, WEAPONS), "CRITICAL (ARMED)").when(contains_any(low, VIOLENCE), "HIGH").otherwise("STANDARD")


def initials_score(mention: Column, name: Column) -> Column:
    """92.0 for two-word names of which the mention has one word as an initial and the other in full, else 0.0."""
    m = F.split(F.trim(F.lower(F.regexp_replace(mention, r"[.\s]+", " "))), " ")
    n = F.split(F.trim(F.lower(F.regexp_replace(name, r"\s+", " "))), " ")
    initial = lambda k: (F.length(F.get(m, k)) == 1) & (F.get(m, k) == F.substring(F.get(n, k), 1, 1))
    same = lambda k: F.get(m, k) == F.get(n, k)
    hit = (F.size(m) == 2) & (F.size(n) == 2) & ((initial(0) & same(1)) | (same(0) & initial(1)))
    return F.when(hit, F.lit(92.0)).otherwise(F.lit(0.0))
