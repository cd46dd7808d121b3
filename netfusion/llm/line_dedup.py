"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words; two are near if one word put in, taken out or replaced turns one into the other, whatever their length. A
line emits a hashed key for each of its variants with one word deleted, and for itself; lines that share a variant are near, and the
earlier one is kept. A variant without words says nothing of a line and isn't emitted, so two lines of one word are near only if equal:

* variants with the word deleted at the same place, from lines of one length, differ by a replacement;
* a variant that equals a whole line differs by a deletion.

Emitting all variants of all lines would be as many rows as words. Near lines must agree on their first or last half (of the shorter
one, rounded down, but at least a word), so lines whose halves occur once are set aside first; that loses no pair. Variants are hashed from running xors over the words' hashes, so a line
of any length costs its words once. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netfusion.llm.common import SPACES, words_of, written
from netfusion.llm.documents import keyed, narrow

#: Words by which near lines may differ.
EDITS = 1
LINE = ["lh", "lh2"]


def _plain(line: Column) -> Column:
    """The line's words with one space between them; searches for what is out of place are far cheaper than a pattern on every line."""
    odd = line.startswith(" ") | line.endswith(" ")
    for x in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(x))
    return F.when(odd, F.btrim(F.regexp_replace(line, SPACES, " "))).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """Each line: its place (known, did, th, pos), number of words n, two hashes and the keys of its halves."""
    places = docs.select(F.col("doc_id").isNotNull().alias("known"), "did", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = places.select("known", "did", "th", "pos", _plain(F.col("line")).alias("x"))
    lines = lines.withColumn("n", F.when(F.col("x") == "", 0).otherwise(F.length("x") - F.length(F.replace(F.col("x"), F.lit(" "), F.lit(""))) + 1))
    x, n = F.col("x"), F.col("n")
    cut = lambda q: F.call_function("substring_index", x, F.lit(" "), q)

    def half(q: Column) -> list[Column]:
        return [F.xxhash64(F.lit(1), q, cut(q)), F.xxhash64(F.lit(2), q, cut(-q))]

    q = F.greatest(F.lit(1), F.expr("n div 2").cast("int"))
    halves = F.when((n % 2 == 0) & (n > 2), F.array(*half(q), *half(q - 1))).when(n > 0, F.array(*half(q)))
    return lines.select("known", "did", "th", "pos", "n", F.xxhash64("x").alias("lh"), F.xxhash64(F.lit(1), x).alias("lh2"), halves.alias("halves"))


def _variants(texts: DataFrame) -> DataFrame:
    """key, kind (0 replaced, 1 deleted, 2 whole), i and line of each variant. texts: lh, lh2, n, w."""
    words = texts.select(*LINE, "n", F.posexplode("w").alias("i", "word"))
    words = words.select(*LINE, "n", "i", F.xxhash64("i", "word").alias("f"), F.xxhash64(F.col("n") - 1 - F.col("i"), "word").alias("g"))
    line = Window.partitionBy(*LINE)
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    xor = lambda c: F.bit_xor(c)
    sums = words.select(*LINE, "n", "i", "f", "g", xor("f").over(upto).alias("pf"), xor("g").over(upto).alias("pg"), xor("g").over(whole).alias("tg"))
    before = F.col("pf").bitwiseXOR(F.col("f"))  # words before i, by their places from the start
    after = F.col("tg").bitwiseXOR(F.col("pg"))  # words after i, by their places from the end
    n, i = F.col("n"), F.col("i")
    variant = lambda kind, key, at: F.struct(key.alias("key"), F.lit(kind).alias("kind"), at.alias("i"))
    last = F.when(i == n - 1, F.array(variant(2, F.xxhash64(F.lit("d"), n, n, F.col("pf"), F.lit(0).cast("long")), n))).otherwise(F.array())
    each = F.array(
        variant(0, F.xxhash64(F.lit("r"), n, i, before, after), i),
        variant(1, F.xxhash64(F.lit("d"), n - 1, i, before, after), i),
        variant(2, F.xxhash64(F.lit("d"), n, i, before, after.bitwiseXOR(F.col("g"))), i),
    )
    each = F.when(n == 1, F.slice(each, 3, 1)).otherwise(each)
    return sums.select(*LINE, F.explode(F.concat(each, last)).alias("v")).select(*LINE, "v.key", "v.kind", "v.i")


def _near_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """lh, lh2 of the lines that an earlier line is near to. lines: one row for each different line, with its first place."""
    each = lines.select(*LINE, F.explode("halves").alias("half"))
    shared = each.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    some, _ = narrow(each, shared, "half")
    found = written(some.join(shared, "half", "left_semi").select(*LINE).distinct(), "lines-shared")
    some, _ = narrow(lines.select(*LINE, "n", "first"), found, *LINE)
    candidates = written(some.join(found, LINE, "left_semi"), "lines-candidates")
    # their words, from the documents of their first places
    wanted = candidates.select("first.did", "first.th", F.struct(F.col("first.pos").alias("pos"), *LINE, "n").alias("c")).groupBy("did", "th").agg(F.collect_list("c").alias("cs"))
    near, _ = narrow(docs.select("did", "th", "text"), candidates.select("first.did", "first.th"), "did", "th")
    rows = near.join(wanted, ["did", "th"]).select(F.split("text", "\n").alias("lines"), "cs").select("lines", F.explode("cs").alias("c"))
    texts = rows.select("c.lh", "c.lh2", "c.n", words_of(F.get("lines", F.col("c.pos"))).alias("w")).dropDuplicates(LINE)
    texts = written(texts, "lines-texts")
    variants = written(_variants(texts), "lines-variants")
    met = variants.groupBy("key").agg(F.min("lh").alias("a"), F.max("lh").alias("z")).where("a <> z").select("key")
    some, _ = narrow(variants, met, "key")
    joined = some.join(met, "key", "left_semi").join(candidates.select(*LINE, "first"), LINE)
    joined = written(joined.select("key", "kind", "i", "first", *LINE), "lines-joined")
    # the earliest replaced or deleted one, and the earliest whole line, of each key
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("first", *LINE)))
    earliest = joined.groupBy("key").agg(*(of(k).alias(f"e{k}") for k in range(3)))
    other = F.when(F.col("kind") == 0, F.col("e0")).when(F.col("kind") == 1, F.col("e2")).otherwise(F.col("e1"))
    pairs = joined.join(earliest, "key").select(*LINE, "kind", "i", "first", other.alias("o")).where("o IS NOT NULL AND o.first < first")
    pairs = pairs.select(*LINE, "kind", "i", F.col("o.lh").alias("olh"), F.col("o.lh2").alias("olh2")).distinct()
    # verify the edit on the words
    words = texts.select(*LINE, "w")
    both = pairs.join(words, LINE).join(words.select(F.col("lh").alias("olh"), F.col("lh2").alias("olh2"), F.col("w").alias("ow")), ["olh", "olh2"])
    without = lambda w: F.concat(F.slice(w, F.lit(1), F.col("i")), F.slice(w, F.col("i") + 2, F.greatest(F.lit(0), F.size(w) - F.col("i") - 1)))
    same = F.when(F.col("kind") == 0, without(F.col("w")) == without(F.col("ow"))).when(F.col("kind") == 1, without(F.col("w")) == F.col("ow")).otherwise(F.col("w") == without(F.col("ow")))
    return both.where(same).select(*LINE).distinct()


def dedup_lines(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """Per document: doc_id, n_lines (lines with words), n_removed and kept_text (the other lines in order, joined by \\n).

    A line goes if an equal or near line comes earlier, by doc_id (null first), then the text's hash, then the line's place; ``edits`` is
    the most words put in, taken out or replaced between near lines, 0 (equal lines only) or 1, at every length; lines are judged on the input, so a removed line removes others too. Lines are equal if
    their words are (what lies between ASCII white space). Lines without words stay. documents: doc_id, text; more columns are
    ignored. A null text is empty; rows that repeat id and text are one document, and each gets its result. An empty table gives none.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    docs = keyed(documents)
    occurrences = written(_lines(docs), "lines").where("n > 0")
    first = F.min(F.struct("known", "did", "th", "pos")).alias("first")
    lines = written(occurrences.groupBy(*LINE).agg(first, F.count("*").alias("c"), F.first("n").alias("n"), F.first("halves").alias("halves")), "lines-different")
    near = written(_near_lines(lines, docs), "lines-near") if edits else lines.select(*LINE).limit(0)
    many = lines.where("c > 1").select(*LINE, "first")
    some, _ = narrow(occurrences.select("known", "did", "th", "pos", *LINE), near, *LINE)
    by_near = some.join(near, LINE, "left_semi").select("did", "th", "pos")
    some, _ = narrow(occurrences.select("known", "did", "th", "pos", *LINE), many, *LINE)
    by_repeat = some.join(many, LINE).where(F.struct("known", "did", "th", "pos") != F.col("first")).select("did", "th", "pos")
    removed = written(by_near.union(by_repeat).groupBy("did", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "lines-removed")
    touched, rest = narrow(docs, removed, "did", "th")
    whole = touched.join(removed, ["did", "th"], "left").select("doc_id", "text", "gone").union(rest.select("doc_id", "text", F.lit(None).cast("array<int>")))
    split = whole.select("doc_id", "text", "gone", F.split("text", "\n").alias("ls"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone")), lambda i: F.get(F.col("ls"), i))
    return split.select(
        "doc_id",
        F.size(F.filter("ls", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
