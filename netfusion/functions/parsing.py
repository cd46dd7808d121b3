"""Amounts, dates, days, phones and durations from free-form strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_DATE = "2026-01-01"
#: Strings that mean "missing".
MISSING = ("", "none", "nan", "null", "-", "na")
#: Unit suffixes of amounts and their factors.
AMOUNT_UNITS = {"cr": 10_000_000, "crore": 10_000_000, "crores": 10_000_000, "l": 100_000, "lac": 100_000, "lakh": 100_000, "lakhs": 100_000, "k": 1_000, "thousand": 1_000, "m": 1_000_000, "million": 1_000_000}
#: Date formats in the order in which they are tried; day before month.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy",
    "M/d/yyyy HH:mm:ss", "M/d/yyyy", "d-M-yyyy HH:mm:ss", "d-M-yyyy", "d-M-yy", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
)


#: Names of months.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_WIDTHS = {"yyyy": (4,), "yy": (2,), "MMMM": range(3, 10), "MMM": (3,), "MM": (2,), "M": (1, 2), "dd": (2,), "d": (1, 2), "HH": (2,), "mm": (2,), "ss": (2,)}


def _shapes(date_format: str) -> set[str]:
    """What strings of a format look like: digits as 0, letters as a."""
    out = {""}
    for part in re.findall(r"y+|M+|d+|H+|m+|s+|'T'|.", date_format):
        sign = "a" if part in ("MMM", "MMMM") else "0"
        ends = [sign * n for n in _WIDTHS[part]] if part in _WIDTHS else ["a" if part == "'T'" else part]
        out = {x + e for x in out for e in ends}
    return out


def _kinds() -> dict[str, str]:
    """For each shape what its numbers are in order: Y year first, D day first, X day or else month first, N day and a month's name, A the name and a day."""
    kinds: dict[str, str] = {}
    for f in DATE_FORMATS:
        kind = "N" if "MMM" in f and f[0] == "d" else "A" if "MMM" in f else "Y" if f[0] == "y" else "D" if f[0] == "d" else "X"
        for shape in _shapes(f):
            kinds[shape] = "X" if kind == "X" else kinds.get(shape, kind)
    return kinds


def is_missing(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(*MISSING)


def parse_amount(x: Column) -> Column:
    """Whole currency units as a long: signs of currency and separators go, a unit suffix multiplies, fractions are cut; missing is 0.

    Multiplied as decimals, so "2.3L" is 230000. A minus sign is lost; without any digit the result is 0.
    """
    s = F.regexp_replace(F.lower(F.trim(x)), r"[,₹$€£\s]|rs\.?|inr", "")
    s = F.regexp_replace(s, r"[/-]+$", "")
    unit = F.regexp_extract(s, r"^\d+(?:\.\d+)?([a-z]+)\.?$", 1)
    factor = F.coalesce(F.create_map(*(F.lit(x) for kv in AMOUNT_UNITS.items() for x in kv))[unit], F.lit(1))
    plain = F.regexp_extract(F.regexp_replace(s, r"[^0-9.]", ""), r"^(\d*\.?\d*)", 1)
    number = F.coalesce(plain.try_cast("decimal(24,6)"), F.lit(0).cast("decimal(24,6)"))
    return F.when(is_missing(x), F.lit(0).cast("long")).otherwise((number * factor.cast("decimal(10,0)")).cast("long"))


def date_parts(x: Column) -> Column:
    """struct of kind and parts of a string that may be a date, for parse_timestamp(); in a column of its own it is computed once a row."""
    whole = F.split_part(F.trim(x), F.lit("."), F.lit(1))  # fractions of seconds are dropped
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shape = F.translate(whole, "0123456789" + letters, "0" * 10 + "a" * 52)
    kind = F.create_map(*(F.lit(v) for kv in _kinds().items() for v in kv))[shape]
    return F.struct(kind.alias("kind"), F.split(whole, r"[-/ :,]+|(?<=\d)T(?=\d)").alias("parts"))


def parse_timestamp(x: Column, cut: Column | None = None) -> Column:
    """A timestamp without zone from epochs (13 or 10 digits), spreadsheet serials (20000 to 80000) or DATE_FORMATS; else null.

    A string's shape says which format it can have, so its parts are read as numbers and no format is tried in vain; a slashed date whose
    month is no month has the month first. ``cut`` is date_parts(x), where it is at hand in a column.
    """
    s = F.trim(x)
    number = s.try_cast("decimal(20,6)")
    cut = date_parts(x) if cut is None else cut
    kind, parts = cut["kind"], cut["parts"]
    n = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    month = F.create_map(*(v for i, m in enumerate(MONTHS) for k in dict.fromkeys((m, m[:3])) for v in (F.lit(k), F.lit(i + 1))))
    name = lambda i: month[F.lower(F.get(parts, F.lit(i)))]
    time = [F.coalesce(n(3), F.lit(0)), F.coalesce(n(4), F.lit(0)), F.coalesce(n(5), F.lit(0)).cast("decimal(8,6)")]
    made = lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, *time)
    year = n(2) + F.when(F.length(F.get(parts, F.lit(2))) == 2, 2000).otherwise(0)
    from_format = (
        F.when(kind == "Y", made(n(0), n(1), n(2)))
        .when(kind.isin("D", "X"), F.coalesce(made(year, n(1), n(0)), F.when(kind == "X", made(year, n(0), n(1)))))
        .when(kind == "N", made(n(2), name(1), n(0)))
        .when(kind == "A", made(n(2), name(0), n(1)))
    )
    return (
        F.when(is_missing(x), F.lit(None).cast("timestamp_ntz"))
        .when(s.rlike(r"^\d{13}$"), F.timestamp_seconds((number / 1000).cast("long")).cast("timestamp_ntz"))
        .when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(number.cast("long")).cast("timestamp_ntz"))
        .when(s.rlike(r"^\d{4,5}(\.0+)?$") & number.between(20_000, 80_000), F.date_add(F.lit("1899-12-30").cast("date"), number.cast("int")).cast("timestamp_ntz"))
        .otherwise(from_format)
    )


def parse_date(x: Column, stamp: Column | None = None) -> Column:
    """The parsed timestamp as ``yyyy-MM-dd HH:mm:ss``, the raw string where nothing fits, null if missing. ``stamp`` is parse_timestamp(x), where
    it is at hand in a column; else it is computed here."""
    stamp = parse_timestamp(x) if stamp is None else stamp
    return F.when(is_missing(x), F.lit(None).cast("string")).otherwise(F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), x))


def to_day(x: Column, base: str = BASE_DATE, stamp: Column | None = None) -> Column:
    """A day number: literal 1 to 365, else days since ``base`` plus 1 within -365 to 730; below 1 or unparsable is null."""
    literal = F.trim(x).try_cast("int")
    days = F.datediff((parse_timestamp(x) if stamp is None else stamp).cast("date"), F.lit(base).cast("date")) + 1
    return F.when(literal.between(1, 365), literal).when(days.between(1, 730), days)


def clean_phone(x: Column) -> Column:
    """Digits only; of more than ten that begin with 91 the last ten."""
    digits = F.regexp_replace(F.coalesce(x, F.lit("")), r"\D", "")
    return F.when((F.length(digits) > 10) & digits.startswith("91"), F.right(digits, F.lit(10))).otherwise(digits)


def clean_duration(x: Column) -> Column:
    """Seconds as a long from a number with s, m or h (or none); anything else is 0."""
    s = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    pattern = r"^(\d+(?:\.\d+)?)\s*(s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hrs|hour|hours)?$"
    number = F.regexp_extract(s, pattern, 1).try_cast("decimal(18,3)")
    unit = F.substring(F.regexp_extract(s, pattern, 2), 1, 1)
    factor = F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.coalesce((number * factor).cast("long"), F.lit(0).cast("long"))
