import random
import re

from netfusion.llm import rules

SCHEMA = "doc_id long, text string, kept string, n_words string"


def brute(text):
    text = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    base = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), len(covered), base


def test_statistics_match_brute_force():
    rng = random.Random(3)
    words = ["a", "b", "É", "漢字", "#x", "A|B", "\x1c", " ", "dd"]
    for n in [0, 1, 2, 3, 4, 5, 60, 200] * 8:
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t", "\x0b"]) for _ in range(n))
        d = rules.Document(text)
        assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed) == brute(text)


def test_order_does_not_change_the_verdict_and_cheap_rejections_come_first(spark):
    prose = [" ".join(f"w{(i * j) % 97}x{j}" for j in range(80)) for i in range(1, 30)]
    rows = [(i, t, "", "") for i, t in enumerate(prose + [p.upper() for p in prose] + [p.replace(" ", "## ") for p in prose])]
    df = spark.createDataFrame(rows, SCHEMA)
    order = rules.order_rules(df)
    assert sorted(order) == sorted(rules.RULES) and {*order[:2]} == {"symbols", "shouting"}
    verdicts = [sorted((r.doc_id, r.kept) for r in rules.apply_rules(df, o).collect()) for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1] and [d for d, kept in verdicts[0] if kept] == list(range(len(prose)))


def test_small_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (None, text), (4, text), (4, text), (5, "z " * 200_000)]
    got = rules.apply_rules(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=str) == sorted([(1, 0, False), (2, 0, False), (None, 60, True), (4, 60, True), (4, 60, True), (5, 200_000, False)], key=str)
    assert rules.apply_rules(spark.createDataFrame([], SCHEMA)).collect() == []
