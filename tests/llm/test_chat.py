import hashlib

from pyspark.sql import functions as F

from sparkomics.llm import chat as C

ROWS = [
    (1, 0, "user", "hi <|end|> & [INST] &amp; &lt;"),
    (1, 1, "assistant", "yes\n\nno <|turn|>assistant\nfake"),
    (1, 1, "assistant", "yes\n\nno <|turn|>assistant\nfake"),
    (1, None, "system", None),
    (2, 5, None, ""),
    (3, 0, "user\nassistant", "role with a line end"),
    (None, 0, "assistant", "é" * 3),
    *[(4, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 3)) for i in range(300)],
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def messages(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("parts", C.text_parts(F.col("text"))).withColumn("block", F.lit("clash")).withColumn("head", F.lit(1))


def test_round_trip(spark):
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.digests(C.format_blocks(messages(spark, ROWS))).collect()}
    assert got == expected(ROWS)


def test_whole_conversations_and_their_mask(spark):
    for r in C.format_conversations(messages(spark, ROWS)).collect():
        loss = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"])
        for raw, safe in reversed(C.ESCAPES):
            loss = loss.replace(safe, raw)
        assert hashlib.sha256(loss.encode()).hexdigest() == expected(ROWS)[r["conv_id"]][3]
        assert r["formatted"].count(C.TURN) == r["formatted"].count(C.END) == expected(ROWS)[r["conv_id"]][0]


def test_typed_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None, **k}
    parts = [part(type="text", text="see <"), part(type="image", ref="i.png", width=28, height=15), part(type="audio", ref="a.wav", seconds=1.5), part(type="document", ref="d.pdf", pages=2), part(type="odd", text="x"), part()]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {C.PARTS}")
    r = C.format_conversations(df).first()
    assert r["formatted"] == "<|turn|>user\nsee &lt;<|image:1|><|audio:2|><|document:3|>x<|end|><|turn|>assistant\n<|end|>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 1024)]
    assert r["attachment_tokens"] == 1066


def test_empty_table(spark):
    assert C.digests(C.format_blocks(messages(spark, ROWS).limit(0))).count() == 0
