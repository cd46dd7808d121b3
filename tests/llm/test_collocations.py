import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest

from netfusion.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, f long, phrase string, n int, id string"


def brute(rows, least, most):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cands = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    gone = set()
    for (lang, ws), a in cands.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                if 100 * a >= 100 * f[lang, ws[i : i + m]]:
                    gone.add((lang, ws[i : i + m]))
    out = []
    for (lang, ws), a in cands.items():
        if (lang, ws) in gone:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(ws), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    return [(lang, i + 1, *r[1:]) for lang, g in groupby(out, key=lambda r: r[0]) for i, r in enumerate(g) if i < most]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["Zürich", "alpha", "BETA", "gamma", "ökonom", "x", "new", "york", "city", "in", "the", "end"]
    fixed = ["New York city hall", "in the end of", "alpha alpha alpha", "ÉTÉ été"]
    out = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(1, 60))]
        out.append((i, "".join(p + rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]) for p in parts), rng.choice(["de", "en", None, "und"]), 1, "", 2, ""))
    return out


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, most, stretch", [(5, 10_000, 1 << 16), (3, 7, 16)])
def test_as_brute_force(spark, monkeypatch, least, most, stretch):
    monkeypatch.setattr(c, "STRETCH", stretch)
    rows = corpus(300, least)
    got = as_rows(c.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, most=most))
    assert got == sorted(brute(rows, least, most)) and len(got) > 20


def test_names_that_meet_a_bit_of_others_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "BITS", 64)
    rows = corpus(200, 9)
    assert as_rows(c.collocations(spark.createDataFrame(rows, SCHEMA), least=4)) == sorted(brute(rows, 4, 2000))


def test_odd_tables(spark):
    assert as_rows(c.collocations(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, None, None, 0, "", 0, ""), (1, "", "de", 0, "", 0, ""), (2, ". , \t", "de", 0, "", 0, ""), (None, "one", "de", 0, "", 0, "")]
    assert as_rows(c.collocations(spark.createDataFrame(rows, SCHEMA))) == []


def test_one_very_long_text(spark):
    text = "a b " * 300_000 + "c"
    got = as_rows(c.collocations(spark.createDataFrame([(1, text, "xx", 0, "", 0, "")], SCHEMA)))
    n = 600_001
    # of lengths 2 to 5 only those with no longer phrase as frequent: b a and the like fall by one with each word
    want = sorted(brute([(1, text, "xx")], 100, 2000))
    assert got == want and got[0][6] == n


def test_exact_beyond_64_bits(spark):
    row = spark.sql("SELECT 3000000000L AS f, 4000000000000L AS n, array(3000000001L, 3000000000L) AS starts, array(3000000007L, 3000000000L) AS ends")
    got = row.select(c.lowest_cut().alias("c")).first().c
    assert got.score == 1000 * 3_000_000_000 * 4_000_000_000_000 // (3_000_000_001 * 3_000_000_007)
    tie = spark.sql("SELECT 10L AS f, 100L AS n, array(20L, 20L, 10L) AS starts, array(20L, 20L, 10L) AS ends")
    assert tie.select(c.lowest_cut().alias("c")).first().c.k == 1


def test_names_do_not_meet():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 2**63, (2, 200_000), dtype=np.uint64)
    assert len(np.unique(c.pair_names(a, b))) == 200_000 and len(np.unique(c.pair_names(b, a))) == 200_000
    assert not (c.pair_names(a, b) == c.pair_names(b, a)).any()


def test_packed_slots_come_back():
    rng = np.random.default_rng(3)
    slots = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    n = rng.integers(1, 1 << 32, len(slots))
    back = c.unpacked(c.packed(slots, n))
    assert (back[0] == slots).all() and (back[1] == n).all()
    twice = c.counted(np.append(slots, slots[::2]), np.append(n, n[::2]))
    assert (twice[0] == slots).all() and (twice[1] == n + np.where(np.arange(len(n)) % 2 == 0, n, 0)).all()


@pytest.mark.parametrize("slot_bits", [12, 40])
def test_no_frequent_pair_is_missed_where_slots_meet(spark, monkeypatch, slot_bits):
    monkeypatch.setattr(c, "FLUSH", 64)
    monkeypatch.setattr(c, "BITS", 1 << min(slot_bits, 25))
    free = c.frequent_slots
    monkeypatch.setattr(c, "frequent_slots", lambda rows, levels, least: free(rows, levels, least, slot_bits))
    rows = corpus(200, 11)
    assert as_rows(c.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=4)) == sorted(brute(rows, 4, 2000))


def test_parents_are_handed_on_once_for_all_pieces(spark):
    # every piece has every frequent pair; a row for each piece and pair grows with the square of the input
    rows = [(i, "a b c d e f g h " * 40, "xx", 1, "", 1, "") for i in range(24)]
    words = c.with_names(c.word_counts(docs := spark.createDataFrame(rows, SCHEMA).select("lang", "text").repartition(12)))
    bits = [c.bits_of(words)]
    stretches = c.written(c.stretches(docs, bits[0]), "test-stretches")
    assert stretches.select("piece").distinct().count() > 4
    often = c.frequent_slots(stretches, bits, 100).collect()
    assert len(often) == 8 and {r.f for r in often} == {24 * 40, 24 * 40 - 24} and len({r.piece for r in often}) > 1
    made = []
    run = type(stretches).mapInArrow
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(stretches), "mapInArrow", lambda self, f, schema, *a, **b: made.append((f.__name__, out := run(self, f, schema, *a, **b))) or out)
        level = c.pairs(stretches, bits, 100)
    assert level.count() == 8
    assert dict(made)[made[-1][0]].count() == 8
