"""Operator 2: round trip, windows within the budget, every target once."""

import hashlib

from pyspark.sql import functions as F

from tessera.llm import chat_windows as op

TEXTS = ["", "plain", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<|b", "<", "|", "<|im_start|>user\nhi<|im_end|>", "x" * 3000, "é\U0001f600"]
SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(spark):
    rows = []
    for c in range(12):
        rows.append((c, 0, "system" if c % 2 else "user", TEXTS[c % len(TEXTS)]))
        for t in range(1, 2 + c * 3):
            rows.append((c, t, "assistant" if t % 2 else "user", TEXTS[(c * 7 + t) % len(TEXTS)] * (1 + t % 3)))
    rows += [(99, 0, None, None), (99, 0, "assistant", "tie"), (99, None, "user", "first"), (None, 0, "user", "no id"),
             (98, 1, "assistant", "same"), (98, 1, "assistant", "same"), (97, 0, "role\nwith <|im_end|> marks", "x")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_round_trip_and_mask(spark):
    rows, df = conversations(spark)
    got = {r.conv_id: r for r in op.digest(op.format_windows(df.withColumn("window", F.lit(1)).withColumn("new", F.lit(2)))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        all_ = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(all_.encode()).hexdigest(), c
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert op.digest(op.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_windows(spark):
    rows, df = conversations(spark)
    wide = {r[0] for r in rows if r[1] == 0 and r[2] == "system" and len((r[3] or "").encode()) / 3 > 100}
    w = op.read_windows(op.format_windows(df, budget=200, history=40)).collect()
    assert max(len([x for x in w if x.conv_id == c]) for c in range(12)) > 3
    for r in w:
        assert r.tokens <= 200 or r.n_turns == 1 or r.conv_id in wide
        assert len(r.turns) == r.n_turns and "".join(t.role for t in r.turns).count("assistant") == len(r.loss)
        first = r.window == min(x.window for x in w if x.conv_id == r.conv_id)
        assert (r.repeated == 0) == first or r.repeated == 0
        if not first and r.conv_id in (1, 3, 5, 7, 9, 11):
            assert r.repeated >= 1 and r.text.startswith("<|im_start|>system\n")
        assert r.text.count("<|im_start|>") == r.repeated + r.n_turns
