import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkomics.llm import packing as P

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")

TEXTS = ["", "one", "It's I'LL don't 12 3.4 ½ ñandú", "İstanbul ΑΣ ßß éx ẛ̣ 日本語 ﬁ", "<|endoftext|> x<|startoftext|>y", "a\x1cb\x1d c\x85d e　f\xa0g", "ŉ ſ K Å", "word " * 5000, "x" * 20_000]


def test_word_ids_are_the_tokenizers_ids():
    enc = P.WordIds(PATH)
    rng = random.Random(1)
    pieces = ["the", "'s", "É", "é", "12", "!?", ".", ",", " ", "\n", "日", "ß", "İ", "\x1f", "<|", "endoftext", "|>", "ing", "́"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_bin_completion_is_a_packing_no_worse_than_best_fit(lengths):
    lengths = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    bins = P.bin_completion(lengths, 60)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 60 for b in bins)
    assert len(bins) <= len(P.best_fit(lengths, 60))
    assert len(bins) >= -(-int(lengths.sum()) // 60)


def test_bin_completion_beats_best_fit_where_it_can():
    lengths = np.array(sorted([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], reverse=True))
    assert len(P.bin_completion(lengths, 60)) == 3 < len(P.best_fit(lengths, 60)) or len(P.best_fit(lengths, 60)) == 3


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place of every piece."""

    def go(i, rooms, seen):
        if i == len(lengths):
            return True
        if (i, rooms) in seen:
            return False
        seen.add((i, rooms))
        return any(go(i + 1, tuple(sorted([*rooms[:k], r - lengths[i], *rooms[k + 1 :]])), seen) for k, r in enumerate(rooms) if r >= lengths[i])

    return next(n for n in range(-(-sum(lengths) // capacity), len(lengths) + 1) if go(0, (capacity,) * n, set()))


def test_bin_completion_goes_back_to_other_fillings():
    rng = random.Random(1)
    cases = [[26, 18, 18, 17, 16, 14, 13, 13, 11, 10], [29, 18, 18, 17, 14, 10, 6, 5]]
    cases += [sorted((rng.randrange(3, rng.choice([20, 30, 40])) for _ in range(rng.randrange(6, 12))), reverse=True) for _ in range(200)]
    for lengths in cases:
        for nodes in (1, P.SEARCH_NODES):
            bins = P.bin_completion(np.array(lengths), 40, nodes)
            assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
            assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
            assert len(bins) == fewest(lengths, 40), lengths


def test_bin_completion_of_short_pieces():
    """Sequences of more than 13 pieces are completed too."""
    lengths = np.sort(np.random.default_rng(3).integers(20, 45, 3000) * 7)[::-1]
    bins = P.bin_completion(lengths, 4096)
    assert max(len(b) for b in bins) > 13
    assert len(bins) < len(P.best_fit(lengths, 4096))


def test_pieces_and_places(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "one"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(3)).withColumn("shard", F.lit("x"))
    out = P.best_fit_packing(df, PATH).collect()
    enc = P.WordIds(PATH)
    want = []
    for d, t in rows:
        ids = np.array([*np.frombuffer(enc.ids(t or ""), "<u4"), 1], dtype="<u4")
        want += [(-1 if d is None else d, k, k * 4096, len(p := ids[k * 4096 : k * 4096 + 4096]), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 4096))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) == -(-sum(w[3] for w in want) // 4096)


def test_empty_table(spark):
    assert P.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_shards_pack_their_emptiest_sequences_together(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.choice([5, 10, 20, 25, 50]), i) for i in range(600)]
    pieces = P.stored(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    out = P.pack(pieces, 100, 40).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(600))
    loads = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == loads.get(r["sequence_id"], 0)
        loads[r["sequence_id"]] = r["offset"] + r["length"]
    least = -(-sum(r[3] for r in rows) // 100)
    assert max(loads.values()) <= 100 and len(loads) <= least + 1  # 15 shards, and no sequence for each
