import zlib

import numpy as np

from netfusion.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string"


def test_filters_hold_all_their_grams():
    rng = np.random.default_rng(0)
    grams = {f"l{i:02d}": rng.integers(0, 2**62, 500, dtype=np.uint64) for i in range(70)}
    f = langid.build(grams, 1 << 16)
    for i, name in enumerate(f.languages):
        assert (f.bits(grams[name])[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)).all()
    other = f.bits(rng.integers(0, 2**62, 20_000, dtype=np.uint64))
    assert abs((other[:, 0] & np.uint64(1)).mean() - f.chance[0]) < 0.001


def test_trigrams():
    unpack = lambda g: "".join(chr(int(g >> np.uint64(s)) & 0x1FFFFF) for s in (42, 21, 0))
    assert [unpack(g) for g in langid.trigrams("Ab, 7\U00010400!")] == [" ab", "ab ", "b \U00010428", " \U00010428 "]
    assert len(langid.trigrams("12 !?")) == 0


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 2000 and sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_small_cases(spark):
    en, de = "the cat and the dog went to the house ", "der hund und die katze gehen nach hause "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (None, en, None), (103, en * 20_000, None), (104, "cat", "en"), (104, "cat", "en")]
    got = langid.identify(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[103].lang_pred == by[104].lang_pred == by[None].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2) for r in got)


def test_nothing_to_learn(spark):
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    got = langid.identify(spark.createDataFrame([(1, "some text", None, "", "")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i) * 3} " * 3, f"l{i}") for i in range(4200)]
    f = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert f.languages == sorted(r[2] for r in rows)


def exact(grams_of, text):
    """The language with the most trigrams of the text (repeats count) in its set, the first by name on ties; no filter, no correction."""
    own = langid.trigrams(text or "").tolist()
    sets = {name: {*g.tolist()} for name, g in grams_of.items()}
    counts = {name: sum(g in s for g in own) for name, s in sets.items()}
    return (max(sorted(counts), key=counts.get), counts) if own else ("und", counts)


def test_against_exact_gram_sets(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    grams_of = langid.typical_grams(df)
    assert len(grams_of) > 2 and all(len(g) <= langid.GRAMS for g in grams_of.values())
    rows = langid.predict(df, langid.build(grams_of)).join(df.select("doc_id", "text"), "doc_id").collect()
    clear = 0
    for r in rows:
        name, counts = exact(grams_of, r.text)
        first, second = (sorted(counts.values(), reverse=True) + [0])[:2]
        if name == "und" or first - second > 2 + 0.02 * len(r.text or ""):  # chance decides between near ones
            clear += 1
            assert r.lang_pred == name
            assert name == "und" or abs(r.score - first / sum(counts.values())) < 0.05
    assert clear > 0.9 * len(rows)


def test_ties_go_to_the_first_name():
    grams = langid.trigrams("some words that two languages share")
    assert langid.build({"b": grams, "a": grams, "c": grams[:3]}).predict("some words that two") [0] == "a"
