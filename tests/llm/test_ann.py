import numpy as np
from pyspark.sql import functions as F

from sparkomics.llm import ann as A


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<float>")


def brute(rows, queries, k=5):
    ok = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(np.array(x, float)).all() and any(x)]
    out = {}
    for i, q in ok:
        if i in queries:
            scored = sorted((-(v @ q) / np.sqrt((v @ v) * (q @ q)), j) for j, v in ok if j != i and len(v) == len(q))
            out[i] = scored[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=48).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[50][1]) for i in range(7)]
    df = table(spark, rows).withColumn("label", F.lit(1)).withColumn("score", F.lit("x"))
    got = {}
    for r in A.search(df, df.filter("vec_id % 50 = 0"), block=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, {i for i, _ in rows if i % 50 == 0})
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
        hits += len({f[1] for f in found} & {j for _, j in want[q]})
    assert hits / (5 * len(want)) >= 0.95
    assert [f[1] for f in sorted(got[50])] == [5000, 5001, 5002, 5003, 5004]
    exact = {(q, j): -s for q, v in want.items() for s, j in v}
    assert all(abs(exact[q, j] - s) < 1e-9 for q, found in got.items() for _, j, s in found if (q, j) in exact)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1, 0, 0]), (1, [1, 1, 0]), (2, None), (3, [0, 0, 0]), (4, [1, None, 0]), (5, [float("nan"), 1, 1]), (6, [float("inf"), 1, 1]), (7, [1, 0]), (8, []), (None, [1, 0, 0]), (50, [0, 0, 1]), (-50, [0, 1, 1]), (100, None)]
    df = table(spark, rows)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in A.search(df, df.filter("vec_id % 50 = 0")).collect()]
    assert sorted(got) == sorted([(0, 1, 1), (0, 2, -50), (0, 3, 50), (50, 1, -50), (50, 2, 0), (50, 3, 1), (-50, 1, 50), (-50, 2, 1), (-50, 3, 0)])
    assert A.search(df.limit(0), df.limit(0)).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = A.hadamard(x)
    assert np.allclose(A.hadamard(y), x) and np.allclose(A.norms(x), A.norms(y))
