"""What a file is and how its columns map: formats, encodings, delimiters, dataset types, mappings. All on names and samples, on the driver."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from netfusion.functions.similarity import indel_ratio
from netfusion.sources.schemas import KEYWORDS, REQUIRED, TURN, aliases, targets

#: Suffixes and formats, encodings in the order of trial, delimiters.
FORMATS = {".csv": "csv", ".xlsx": "xlsx", ".xls": "xlsx", ".json": "json", ".txt": "txt", ".log": "txt", ".tsv": "txt", ".pdf": "pdf", ".docx": "docx"}
ENCODINGS = ("utf-8-sig", "utf-8", "latin-1", "cp1252", "iso-8859-1")
DELIMITERS = (",", ";", "\t", "|")
FUZZY = 85.0


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def sniff_delimiter(sample: str) -> str:
    """The delimiter of a table's beginning: what the csv module finds, else the most frequent of the first five lines, else a comma."""
    sample = sample[:8192]
    try:
        return csv.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
    except csv.Error:
        lines = [x for x in sample.splitlines() if x.strip()][:5]
        counts = {d: sum(x.count(d) for x in lines) for d in DELIMITERS}
        best = max(DELIMITERS, key=counts.__getitem__)
        return best if counts[best] else ","


def detect_format(name: str, head: bytes = b"") -> str:
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix in FORMATS:
        return FORMATS[suffix]
    text = decode(head).lstrip()
    if text[:1] in ("{", "["):
        return "json"
    try:
        csv.Sniffer().sniff(text[:2048], "".join(DELIMITERS))
        return "csv"
    except csv.Error:
        return "unknown"


def is_table(text: str, suffix: str = "") -> bool:
    """If a plain text is a table: a delimiter in both of its first two lines and short header cells; .tsv always is."""
    if suffix == ".tsv":
        return True
    lines = [x for x in text.splitlines() if x.strip()][:2]
    if len(lines) < 2:
        return False
    for d in DELIMITERS:
        if d in lines[0] and d in lines[1]:
            return all(len(cell.split()) <= 5 for cell in lines[0].split(d))
    return False


def clean_header(name: str) -> str:
    """White space and - . / as underscores, other signs dropped, underscores collapsed, small letters."""
    name = re.sub(r"[\s\-./]+", "_", str(name).strip())
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_]", "", name)).strip("_").lower()


def detect_type(columns: Sequence[str]) -> tuple[str, float]:
    """The dataset whose keywords the column names hold most of, and the share; below 0.15 it is unknown."""
    names = " ".join(c.lower() for c in columns)
    extra = {
        "cdrs": 0.3 * ("caller_phone" in names or "callee_phone" in names),
        "transactions": 0.2 * ("amount" in names),
        "firs": 0.3 * ("narrative" in names),
        "people_directory": 0.3 * ("phone" in names and "account" in names),
    }
    scores = {k: sum(w in names for w in words) / len(words) + extra.get(k, 0.0) for k, words in KEYWORDS.items()}
    best = max(scores, key=scores.__getitem__)
    confidence = min(1.0, scores[best])
    return ("unknown", confidence) if confidence < 0.15 else (best, round(confidence, 3))


def suggest_mapping(columns: Sequence[str], dataset: str) -> dict[str, str | None]:
    """For each target column the source column that fits: by name or alias, then by alias without signs, then by similarity of 85 or
    more. Phones and accounts choose first; a source column is used once."""
    wanted = targets(dataset)
    rank = lambda t: TURN.get(t, 5)
    bare = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    free = {c: clean_header(c) for c in columns}
    found: dict[str, str | None] = dict.fromkeys(wanted)

    def settle(fits) -> None:
        for t in sorted(wanted, key=rank):
            if found[t] is None:
                for a in aliases(t):
                    hit = next((c for c, clean in free.items() if fits(clean, a)), None)
                    if hit is not None:
                        found[t] = hit
                        del free[hit]
                        break

    for t in sorted(wanted, key=rank):  # names that are exact come before any alias
        hit = next((c for c, clean in free.items() if clean == t), None)
        if hit is not None:
            found[t] = hit
            del free[hit]
    settle(lambda clean, a: clean == a)
    settle(lambda clean, a: bare(clean) == bare(a))
    settle(lambda clean, a: indel_ratio(bare(clean), bare(a)) >= FUZZY)
    return found


def validate_mapping(mapping: dict[str, str | None], dataset: str) -> tuple[bool, list[str]]:
    """If each required group has a mapped column, and the first names of the groups that have none."""
    missing = [group[0] for group in REQUIRED.get(dataset, ()) if not any(mapping.get(c) for c in group)]
    return not missing, missing


def review_mapping(columns: Sequence[str], dataset: str, changes: dict[str, str | None]) -> dict[str, str | None]:
    """The suggestion with a user's changes; all or none are taken, and unknown columns raise."""
    unknown = {c for c in changes.values() if c} - {*columns} | {t for t in changes if t not in targets(dataset)}
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    return suggest_mapping(columns, dataset) | changes
