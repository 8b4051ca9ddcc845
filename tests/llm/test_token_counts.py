import random

import pytest
from pyspark.sql import functions as F

from sparkomics.llm import token_counts as T

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "word", " ", "  ", "\n", "\t", "\x1c", "é", "日本語", "'s", "12", "!?", " the", "　", "\xa0", "<|endoftext|>"]


def applied(text, edits):
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1], e[2] or "")):
        start = min(max(start, 0, at), len(text))
        end = min(max(end, start), len(text))
        out += [text[at:start], new or ""]
        at = end
    return "".join([*out, text[at:]])


def test_matches_whole_encoding(spark):
    rng, encode = random.Random(3), T.encoder(RANKS).encode_ordinary
    make = lambda k: "".join(rng.choice(PIECES) for _ in range(k))
    rows = []
    for d in range(150):
        text = make(rng.choice([0, 1, 5, 60, 400]))
        edits = [(rng.randrange(-2, len(text) + 3), 0, make(rng.randrange(0, 5))) for _ in range(rng.randrange(0, 6))]
        rows.append((d, text, [(s, s + rng.randrange(0, 30), new) for s, _, new in edits]))
    rows += [(1000, None, None), (1001, "x" * 5000, [(2500, 2501, " ")]), (1002, " ".join(["word"] * 4000), [(10_000, 10_004, "other")]), (1003, "abc", [(0, 3, None)]), (1004, "日本語の文。" * 3000, [(9_000, 9_001, "字")])]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    edits = spark.createDataFrame([(d, *e) for d, _, es in rows for e in es or ()], "doc_id long, start long, end long, replacement string")
    got = {r["doc_id"]: r for r in T.recount(T.with_edits(T.build(docs, RANKS, 16), edits), RANKS).collect()}
    for d, text, es in rows:
        after = applied(text or "", es or [])
        assert got[d]["n_tokens"] == len(encode(text or ""))
        assert (got[d]["n_tokens_after"], got[d]["n_chars_after"]) == (len(encode(after)), len(after)), (d, es)
    assert got[1002]["encoded_chars"] < 200 and got[1004]["encoded_chars"] < 200


def test_revision_and_edge_rows(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, None)], "doc_id long, text string").withColumn("tokens", F.lit(1)).withColumn("edits", F.lit("x"))
    got = T.recount(T.revision(T.build(df, RANKS)), RANKS)
    assert got.count() == 3
    assert T.recount(T.revision(T.build(df.limit(0), RANKS)), RANKS).count() == 0
