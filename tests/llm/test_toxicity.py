import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkomics.llm import toxicity as X

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RUDE = ["zounds", "blighter", "knave", "scoundrel"]


def corpus(n=1500):
    rng = random.Random(4)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for d in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 90))]
        toxic = d % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(RUDE)
        rows.append((d, " ".join(words).capitalize(), "en", "s", 1))
        if d % 4:
            labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in X.toxicity(df, known).collect()}
    assert len(out) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    held = [(r["predicted"], int(d % 6 == 0)) for d, r in out.items() if r["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus(600)
    df = spark.createDataFrame(rows, SCHEMA)
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    score = lambda ls: {r["doc_id"]: r["score"] for r in X.toxicity(df, spark.createDataFrame(ls, "doc_id long, toxic int")).collect()}
    assert score(labels) == score(flipped)


def test_keep_clean_and_edge_rows(spark):
    rows, labels = corpus(900)
    rows = [*rows, (5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "knave " * 20_000, "en", "s", 1), (1, rows[1][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("score", F.lit(7)).withColumn("word", F.lit(1))
    known = spark.createDataFrame([*labels, (2, None), (None, 1), (1, 0)], "doc_id long, toxic int").withColumn("text", F.lit("t"))
    out = X.keep_clean(df, known)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert {5000, 5001} <= set(kept) and None not in kept and kept.count(1) == 2
    toxic = {r[0] for r in rows if r[0] is not None and r[0] < 900 and r[0] % 6 == 0}
    assert len(toxic & set(kept)) < 0.05 * len(toxic) and len(set(kept) - toxic) > 0.97 * (900 - len(toxic))
    assert X.keep_clean(df.limit(0), known).count() == 0
    assert X.toxicity(df, known.limit(0)).agg(F.max("score")).first()[0] == 0.0


def plain_features(train, texts, discount=X.DISCOUNT, gate=X.GATE):
    """The model stated plainly: chain rule over words given the words before, of pairs and words that pass the gate."""
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = {n: {c: Counter() for c in (0, 1)} for n in (1, 2)}
    for text, toxic in train:
        w = split(text)
        counts[1][toxic].update(set(w))
        counts[2][toxic].update(set(zip(w, w[1:])))
    ratio = {1: {}, 2: {}}
    for n, by in counts.items():
        total, types = {c: sum(by[c].values()) for c in (0, 1)}, {c: len(by[c]) for c in (0, 1)}
        for g in by[0].keys() | by[1].keys():
            shared = (by[0][g] + by[1][g]) / (total[0] + total[1])
            surprise = sum(2 * by[c][g] * math.log(by[c][g] / (total[c] * shared)) for c in (0, 1) if by[c][g])
            own = [(max(by[c][g] - discount, 0) + discount * types[c] * shared) / total[c] for c in (0, 1)]
            if surprise >= gate:
                ratio[n][g] = math.log(own[1] / own[0])
    out = []
    for text in texts:
        w = split(text)
        given = [ratio[2][v, a] - ratio[1].get(v, 0.0) if (v, a) in ratio[2] else ratio[1].get(a, 0.0) for v, a in zip([None, *w], w)]
        out.append(sum(given) / max(1, sum(len(a.encode()) + 1 for a in w)))
    return out, ratio


def test_features_against_a_plain_model(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    train = []
    for d in range(700):
        w = [rng.choice(words) for _ in range(rng.randrange(1, 30))]
        if d % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice([["ba", "ce"], ["zounds"], ["zounds", "di"]])
        train.append((" ".join(w), int(d % 5 == 0)))
    texts = [t for t, _ in train[:50]] + ["", "ba ce", "ce ba ce", "Zounds! Zounds di", "di", "1 2"]
    rows = spark.createDataFrame([(t, bool(y)) for t, y in train], "text string, toxic boolean").withColumn("half", F.lit(0))
    counts = X.stored(X.word_counts(rows), "counts")
    model = X.stored(X.interactions(rows, X.stored(X.log_ratios(counts.select("size", "key", F.col("t0").alias("t"), F.col("o0").alias("o"))), "ratios")), "model")
    got = [r["x"] for r in X.features(spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1), model).orderBy("i").collect()]
    want, ratio = plain_features(train, texts)
    assert ("ba", "ce") in ratio[2] and "ba" not in ratio[1]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_model_in_blocks(spark):
    rows, labels = corpus(600)
    df = spark.createDataFrame(rows, SCHEMA)
    scorer = X.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    one = {r["doc_id"]: r["x"] for r in X.features(df, scorer.model).collect()}
    many = {r["doc_id"]: r["x"] for r in X.features(df, scorer.model, most=2).collect()}
    assert all(abs(one[d] - many[d]) < 1e-12 for d in one)
