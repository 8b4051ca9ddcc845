"""LOWESS, imputation and special functions against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkomics.functions import special
from sparkomics.operators import smoothing, tables


def plain_lowess(x, y, f, iterations):
    """Point by point, over all points."""
    n = len(x)
    r = min(math.ceil(f * n), n - 1)
    reach = np.array([np.sort(np.abs(x - v))[r] for v in x])
    fitted, robust = np.zeros(n), np.ones(n)
    for _ in range(iterations):
        for i in range(n):
            d = x - x[i]
            u = np.clip(np.abs(d) / reach[i] if reach[i] > 0 else (d != 0).astype(float), 0, 1)
            w = (1 - u**3) ** 3 * robust
            s = w.sum()
            if s <= 0:
                fitted[i] = y[i]
                continue
            mx, my = w @ d / s, w @ y / s
            spread = w @ (d - mx) ** 2
            slope = 0 if spread <= 1e-12 * s * reach[i] ** 2 else w @ ((d - mx) * (y - my)) / spread
            fitted[i] = my - slope * mx
        off = np.abs(y - fitted)
        wide = 6 * np.median(off)
        robust = (1 - np.clip(off / wide, 0, 1) ** 2) ** 2 if wide > 0 else np.ones(n)
    return fitted


def curve(seed, n, ties=False):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.normal(size=n)) ** 3 * 50 + 1000
    x = np.round(x / 20) if ties else x
    y = np.sin(x / 40) * 5 + rng.normal(size=n) + (rng.random(n) < 0.05) * 40
    return x, y


@pytest.mark.parametrize("f, block", [(2 / 3, 16), (0.1, 8)])
def test_lowess(spark, f, block):
    curves = {"a": curve(1, 150), None: curve(2, 40, ties=True), "one": (np.array([3.0]), np.array([7.0])), "flat": (np.full(9, 2.0), np.arange(9.0))}
    rows = [(g, float(a), float(b), k) for g, (x, y) in curves.items() for k, (a, b) in enumerate(zip(x, y))]
    random.Random(1).shuffle(rows)
    rows += [("a", None, 1.0, 900), ("a", 5.0, None, 901), ("a", float("nan"), 2.0, 902)]
    df = spark.createDataFrame(rows, "g string, x double, y double, fitted int").withColumnRenamed("fitted", "k")
    got = {(r["g"], r["k"]): r["fitted"] for r in smoothing.lowess(df, ["g"], "x", "y", f, 3, block).collect()}
    assert len(got) == len(rows) and all(got["a", k] is None for k in (900, 901, 902))
    for g, (x, y) in curves.items():
        want = plain_lowess(x, y, f, 3)
        assert np.allclose([got[g, k] for k in range(len(x))], want, rtol=1e-6, atol=1e-6), g


def test_lowess_of_one_curve(spark):
    x, y = curve(3, 400)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "k long, x double, y double")
    got = {r["k"]: r["fitted"] for r in smoothing.lowess(df, [], "x", "y", 0.3, 2, 20).collect()}
    assert np.allclose([got[k] for k in range(400)], plain_lowess(x, y, 0.3, 2), rtol=1e-6, atol=1e-6)
    assert smoothing.lowess(df.limit(0), [], "x", "y").collect() == []


def plain_impute(rows, columns, k, rounds, strict):
    """rows: {key: [values]} with None; columns: places to fill, in order."""
    now, width = {i: list(v) for i, v in rows.items()}, len(next(iter(rows.values())))
    for _ in range(rounds):
        before = {i: list(v) for i, v in now.items()}
        for c in columns:
            use = [o for o in range(width) if o != c and all(v[o] is not None for v in now.values())]
            if not use:
                continue
            base = rows if strict else {i: list(v) for i, v in now.items()}
            known = {i: (now[i], base[i][c]) for i in now if base[i][c] is not None}
            filled = {}
            for i, v in now.items():
                if rows[i][c] is None:
                    near = sorted((math.sqrt(sum((v[o] - w[o]) ** 2 for o in use)), j) for j, (w, _) in known.items())[:k]
                    weight = [1 / (d + 1e-9) if strict else d for d, _ in near]
                    total = sum(weight) * (1 if strict else k)
                    filled[i] = sum(known[j][1] * w for (_, j), w in zip(near, weight)) / total if total else None
            for i, x in filled.items():
                now[i][c] = x
        if now == before:
            break
    return now


@pytest.mark.parametrize("strict", [True, False])
def test_impute(spark, strict):
    rng = random.Random(4)
    rows = {i: [float(rng.randrange(50)), rng.random() * 20, rng.random() * 9] for i in range(80)}
    for i in range(80):
        if i % 6 == 0:
            rows[i][1] = None
        if i % 11 == 3:
            rows[i][2] = None
    df = spark.createDataFrame([(i, *v, "x") for i, v in rows.items()], "id long, a double, b double, c double, other string")
    got = {r["id"]: list(r)[1:4] for r in tables.impute(df, "id", ["a", "b", "c"], rounds=2, strict=strict).collect()}
    want = plain_impute(rows, [1, 2], 3, 2, strict)
    for i in rows:
        assert [x is None for x in got[i]] == [x is None for x in want[i]]
        assert [x or 0 for x in got[i]] == pytest.approx([x or 0 for x in want[i]], rel=1e-9)
    assert tables.training_columns(df, "b", ["a", "b", "c"]) == ["a"]


def test_impute_ends_when_nothing_changes(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, None, 2.0)], "id long, a double, b double")
    assert sorted(map(tuple, tables.impute(df, "id", ["a", "b"]).collect())) == [(1, None, None), (2, 1.0, None), (3, None, 2.0)]
    df = spark.createDataFrame([(i, float(i), 2.0 * i if i % 3 else None) for i in range(12)], "id long, a double, b double")
    got = {r["id"]: r["b"] for r in tables.impute(df, "id", ["a", "b"], k=1).collect()}
    assert got[3] == 4.0 and got[1] == 2.0


def test_tails_of_distributions():
    """Against closed forms: t with 1 and 2 degrees of freedom, chi-square with 2 and 4."""
    t = np.array([0.0, 0.3, 1.0, 2.5, 40.0, -1.0, np.nan, np.inf])
    one = 1 - 2 / np.pi * np.arctan(np.abs(t))
    two = 1 - np.abs(t[:-1]) / np.sqrt(2 + t[:-1] ** 2)
    assert np.allclose(special.t_tails(t, np.ones(8)), one, equal_nan=True, atol=1e-13)
    assert np.allclose(special.t_tails(t[:-1], np.full(7, 2.0)), two, equal_nan=True, atol=1e-13)
    assert np.isnan(special.t_tails(np.array([1.0]), np.array([0.0])))[0]
    x = np.array([0.0, 0.1, 1.0, 7.0, 200.0])
    assert np.allclose(special.gamma_tail(np.ones(5), x / 2), np.exp(-x / 2), rtol=1e-12)
    assert np.allclose(special.gamma_tail(np.full(5, 2.0), x / 2), np.exp(-x / 2) * (1 + x / 2), rtol=1e-12)


def test_neighbourhoods_without_a_frame_up_to_the_end(spark):
    """Spark goes through such a frame anew for each row: the square of a range's rows."""
    rows = spark.range(300).select(F.col("id").alias("__id"), (F.col("id") * 7 % 300).cast("double").alias("__x"))
    told = smoothing.neighbourhoods(rows, [], 0.4)
    from_here = "(RowFrame, currentrow$(), unboundedfollowing$())"
    assert told.count() == 300 and from_here not in told._jdf.queryExecution().toString()
