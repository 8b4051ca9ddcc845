import random
import re

import pytest
from pyspark.sql import functions as F

from sparkomics.llm import ngram_join as N
from sparkomics.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, percent=75):
    """doc_id -> (n_shingles, component_id)."""
    sets = {}
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    base, common = [text(rng.randrange(20, 90)) for _ in range(12)], text(30)
    rows = []
    for d in range(n):
        kind = rng.random()
        t = list(rng.choice(base[:3] if kind < 0.5 else base)) if kind < 0.8 else text(rng.randrange(0, 40))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.4:
            t = t + common
        rows.append((d * 3 + 1, rng.choice([" ", "  ", "\n"]).join(t).replace("w1", "W1")))
    return [*rows, (2, None), (5, ""), (8, " \n"), (11, "Kurz und gut"), (14, "kurz und\tgut"), (17, "gut und kurz"), (20, rows[0][1]), (23, "a" * 3000 + " b c d e f")]


@pytest.mark.parametrize("small, tile", [(2, 8192), (2, 7), (16, 16)])
def test_against_brute_force(spark, small, tile):
    rows = corpus(small + tile)
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.joined(df, small_bucket=small, tile=tile).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 100


def test_near_copies_on_both_sides_of_the_threshold_a_common_passage_and_long_texts(spark):
    """A group whose copies are linked to what they were made from, or through others, or not at all."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base, passage = [rng.choice(words) for _ in range(150)], [rng.choice(words) for _ in range(60)]
    rows = [(0, " ".join(base))]
    for d in range(1, 160):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((d, " ".join(t)))
    rows += [(d, " ".join(passage + [rng.choice(words) for _ in range(rng.randrange(0, 25))])) for d in range(300, 360)]
    long = [rng.choice(words) for _ in range(60_000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[:50_000])), (502, " ".join(long[20_000:]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.joined(spark.createDataFrame(rows, "doc_id long, text string"), tile=64).collect()}
    want = brute(rows)
    assert got == want
    assert 20 < sum(c != 0 for d, (_, c) in want.items() if d < 160) < 150


def test_one_of_each_and_clashing_columns(spark):
    rows = [(3, "a b c d e f", None, "x", 1), (1, "A b c d e f", "en", "x", 1), (1, "A b c d e f", "en", "x", 1), (None, "a b c d e f", "en", "x", 1), (7, None, "en", "x", 1), (9, None, "en", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("class", F.lit(1)).withColumn("component_id", F.lit("c")).withColumn("shingle", F.lit(2))
    out = N.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 1, 7, 9]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in N.joined(df).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (3, 2, 1), (7, 0, 7), (9, 0, 9)]


def test_empty_table(spark):
    assert N.joined(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if (root[a], root[b]) != (m, m):
                root[a] = root[b] = m
                changed = True
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in root.items() if k in got} == got
    assert set(root) - set(got) <= loops
