import hashlib

from netfusion.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments string"


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, ts in by.items():
        ts = sorted(ts)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t[3] for t in ts if t[2] == "assistant")
        out[c] = (len(ts), sha("".join(f"{r}\n{x}\n" for *_, r, x in ts)), len(loss), sha(loss))
    return out


def test_round_trip(spark):
    hard = ["", "<|end|>", "<||end|>", "<", "<|", "|>", "<|next|>a<|role|>", "<<|text|>", "line\nline", "é\U0001f600", "\\E$1", "</s>[INST] ok [/INST]"]
    rows = [(1, i, "user" if i % 3 else "assistant", x) for i, x in enumerate(hard)]
    rows += [(2, i, "assistant", x) for i, x in enumerate(hard)]
    rows += [(3, None, "user", "first"), (3, 5, None, "no role"), (3, 5, "<|text|>", None), (3, 5, None, "no role"), (None, 1, "user", "a"), (None, 0, "assistant", "b")]
    rows += [(4, i, ["user", "assistant"][i % 2], "word " * 20) for i in range(3000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(formatted).collect()}
    assert got == brute(rows)


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "", ""), (1, 1, "user", "b", "", ""), (1, 2, "assistant", "c", "", "")], SCHEMA)
    row = chat.format_conversations(df).collect()[0]
    assert row.formatted == "<|role|>user<|text|>a<|next|>b<|end|><|role|>assistant<|text|>c<|end|>"
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["c"]


def test_merged_blocks_across_chunks(spark, monkeypatch):
    import itertools

    monkeypatch.setattr(chat, "CHUNK", 4)
    for n in (1, 3, 4, 5, 8, 9, 23):
        roles = [("user", "assistant", "assistant", "assistant", "assistant", "assistant", "tool")[i % 7] for i in range(n)]
        df = spark.createDataFrame([(1, i, r, f"t{i}<|end|>", "", "") for i, r in enumerate(roles)], SCHEMA)
        row = chat.format_conversations(df).collect()[0]
        texts = iter(f"t{i}<||end|>" for i in range(n))
        blocks = [(r, [next(texts) for _ in g]) for r, g in itertools.groupby(roles)]
        assert row.formatted == "".join(f"<|role|>{r}<|text|>{'<|next|>'.join(t)}<|end|>" for r, t in blocks)
        assert "".join(s.text for s in row.segments) == row.formatted
        assert [s.text for s in row.segments if s.loss] == [x for r, t in blocks if r == "assistant" for x in t]


def test_empty(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
