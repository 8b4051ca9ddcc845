import random
import re
from collections import Counter
from math import log1p

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkomics.llm import decontamination as D

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items):
    """doc_id, item_id -> similarity of the best window."""
    bags = {i: grams(words(t)) for i, t in items if len(words(t)) >= 5}
    size = {i: len(words(t)) for i, t in items}
    df = Counter(g for b in bags.values() for g in b)
    weight = lambda g: log1p(len(bags) / df.get(g, 1))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, bag in bags.items():
            best = 0
            for s in range(len(w) - size[i] + 1):
                own = grams(w[s : s + size[i]])
                if own.keys() & bag.keys():
                    best = max(best, sum(weight(g) * min(own[g], bag[g]) for g in own | bag) / sum(weight(g) * max(own[g], bag[g]) for g in own | bag))
            if best >= 0.75:
                out[d, i] = best
    return out


def corpus():
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(500)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, text(rng.randrange(12, 60))) for i in range(30)]
    items[3] = (3, items[2][1][:20] + text(5))
    docs = []
    for d in range(120):
        t = text(rng.randrange(0, 80))
        if d % 2:
            leak = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                leak[rng.randrange(len(leak))] = "changed"
            cut = rng.randrange(0, 3)
            t[rng.randrange(0, len(t) + 1) : 0] = leak[cut:]
        docs.append((d, rng.choice([" ", ", ", "!\n"]).join(t).upper() if d % 5 == 0 else " ".join(t)))
    return docs, [(i, " ".join(t)) for i, t in items] + [(90, "too short"), (91, None), (92, "")]


def test_against_brute_force(spark):
    docs, items = corpus()
    rows = [*docs, (500, None), (501, ""), (502, docs[1][1])]
    want = brute(rows, items)
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (D.ITEM_BLOCK, 7):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.contamination(df, bench, item_block=block).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 25


def test_documents_shorter_than_the_item(spark):
    """A document that is an item less some words is its whole window, if it is similar enough."""
    item = [f"w{i}" for i in range(60)]
    docs = [(n, " ".join(item[:n])) for n in (60, 59, 55, 50, 45, 40, 4)] + [(100, " ".join(item[5:])), (101, " ".join(["x", *item[1:57]]))]
    other = (8, " ".join(f"v{i}" for i in range(30)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), other], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["start_word"], r["n_words"], round(r["similarity"], 9)) for r in D.contamination(df, bench).collect()}
    # A document of n words has n - 4 of the 56 shingles, all of equal weight but those that the benchmark doesn't have.
    want = {n: (7, 0, n, round((n - 4) / 56, 9)) for n in (60, 59, 55, 50)} | {100: (7, 0, 55, round(51 / 56, 9))}
    assert {k: v for k, v in got.items() if k != 101} == want
    assert got[101][:3] == (7, 0, 57)
    assert {r["doc_id"] for r in D.clean(df, bench).collect()} == {45, 40, 4}


def test_clean_and_edge_rows(spark):
    docs, items = corpus()
    leaked = {d for d, _ in brute(docs, items)}
    rows = [(d, t, "en", "s", len(t)) for d, t in docs] + [(None, items[0][1], None, None, None), (600, None, "en", "s", 0), (601, "now too short it is", None, None, None), (602, items[0][1][:12], None, None, None), (602, items[0][1], None, None, None), (603, "Too, short!", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit(1)).withColumn("block", F.lit("b"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1)).withColumn("weight", F.lit(2))
    out = D.clean(df, bench)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == ({d for d, _ in docs} - leaked) | {600, 601, 602}
    assert D.clean(df.limit(0), bench).count() == 0
    assert D.clean(df, bench.limit(0)).count() == len(rows)
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in D.contamination(df.filter("doc_id IN (601, 603)"), bench).collect()] == [(603, 90, 1.0)]


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = [(i, rng.integers(0, 2**63, 20).astype(np.uint64)) for i in range(200)]
    index = D.ItemIndex(items, {}, 1.0, D.RADIUS)
    at, prints, _ = index.by_length[20]
    near = prints.copy()
    for i in range(len(near)):
        for bit in rng.choice(128, D.RADIUS, replace=False):
            near[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    window, item, distance = index.near(near, 20)
    assert {(i, i) for i in range(200)} <= set(zip(window.tolist(), item.tolist())) and distance.max() == D.RADIUS
    tables = index.index(20)
    chance = np.mean([len(np.unique(v)) for v, _ in tables]) / 65536
    assert len(tables) == D.BLOCKS and len(tables[0][0]) / len(items) / 65536 < 0.02, chance


@pytest.mark.parametrize("size", [20, 40, 80, 200, 400])
def test_similar_windows_outside_the_radius_are_rare(size):
    """Of windows similar enough, changed at their ends where words change most for it, how many the radius loses, by length."""
    rng, lost = np.random.default_rng(size), 0
    for k in range(2000):
        item = rng.integers(0, 2**63, size).astype(np.uint64)
        changed = (size - 4) // 7  # (shingles - changed) / (shingles + changed) >= 0.75
        first = changed if k % 2 else changed // 2
        window = item.copy()
        window[:first] = rng.integers(0, 2**63, first)
        if changed > first:
            window[first - changed :] = rng.integers(0, 2**63, changed - first)
        lost += int(np.bitwise_count(D.fingerprints(item, size) ^ D.fingerprints(window, size)).sum() > D.RADIUS)
    assert lost <= 1, lost


def test_long_texts_and_a_hot_item(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "x " * 200_000 + item), (2, "y" * 500_000), *[(10 + i, f"a{i} {item}") for i in range(400)]]
    found = D.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert len(found) == 401 and {r["similarity"] for r in found} == {1.0} and {r["start_word"] for r in found} == {1, 200_000}
