"""Fitted models: local and linear regression, principal components, enrichment scores, count normalisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkomics.functions.special import t_two_sided
from sparkomics.operators.stats import with_rank


def regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, slope, intercept, r2, n, p of a simple linear regression; p is two-sided."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    t = F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    return fit.withColumn("p", t_two_sided(t, (F.col("n") - 2).cast("double")))


def residuals(df: DataFrame, covariates: list[str], values: list[str], intercept: bool = True) -> DataFrame:
    """The rows with `<value>_residual`: what a linear model of the covariates leaves of each value.

    The normal equations come from one aggregation; only a matrix of covariates by covariates reaches the driver.
    """
    terms = [F.col(c).cast("double") for c in covariates] + ([F.lit(1.0)] if intercept else [])
    known = df.dropna(subset=[*covariates, *values])
    products = known.agg(*[F.sum(a * b) for a in terms for b in terms], *[F.sum(a * F.col(v)) for v in values for a in terms]).first()
    k = len(terms)
    if products[0] is None:
        return df.select("*", *[F.lit(None).cast("double").alias(f"{v}_residual") for v in values])
    gram = np.array(products[: k * k], dtype=float).reshape(k, k)
    right = np.array(products[k * k :], dtype=float).reshape(len(values), k)
    weights = right @ np.linalg.pinv(gram)
    predicted = lambda w: sum((t * float(c) for t, c in zip(terms, w)), F.lit(0.0))
    return df.select("*", *[(F.col(v) - predicted(w)).alias(f"{v}_residual") for v, w in zip(values, weights)])


def pca(df: DataFrame, columns: list[str], components: int = 2) -> DataFrame:
    """The rows with PCA_1, ...: projections of the centred columns; of each component the largest weight is positive.

    The covariances come from one aggregation; only they reach the driver.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(a, b) for a, b in pairs]).first()
    mean, cov = row[: len(columns)], np.zeros((len(columns), len(columns)))
    for (a, b), v in zip(pairs, row[len(columns) :]):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = v or 0.0
    _, vectors = np.linalg.eigh(cov)
    out = []
    for k in range(components):
        w = vectors[:, -1 - k]
        w = w * np.sign(w[np.argmax(np.abs(w))])
        out.append(sum(((F.col(c) - float(m or 0)) * float(x) for c, m, x in zip(columns, mean, w)), F.lit(0.0)).alias(f"PCA_{k + 1}"))
    return df.select("*", *out)


def axis_of_effect(df: DataFrame, condition: str, first: str, second: str, components: list[str]) -> DataFrame:
    """component, effect: the difference of both conditions' means."""
    mean = lambda name, c: F.avg(F.when(F.col(condition) == name, F.col(c)))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("component"), (mean(second, c) - mean(first, c)).alias("effect")) for c in components]).alias("x"))
    return row.select(F.inline("x"))


def gsea_scores(df: DataFrame, by: list[str], score: str, member: str, tie: str, power: float = 1) -> DataFrame:
    """by, es, at: the largest lead of members over others, ascending by score, and the row where it is; the last row of
    all doesn't count, and of equal leads the later row does."""
    w = Window.partitionBy(*by)
    order = w.orderBy(score, tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col(member), F.pow(F.col(score), F.lit(float(power)))).otherwise(0.0)
    other = (~F.col(member)).cast("double")
    run = df.withColumn("__i", F.row_number().over(order)).withColumn("__n", F.count("*").over(w))
    lead = F.try_divide(F.sum(weight).over(so_far), F.sum(weight).over(w)) - F.try_divide(F.sum(other).over(so_far), F.sum(other).over(w))
    run = run.withColumn("__lead", lead).filter("__i < __n")
    return run.groupBy(*by).agg(F.max(F.struct("__lead", "__i")).alias("x")).select(*by, F.col("x.__lead").alias("es"), F.col("x.__i").alias("at"))


def gsea_permutations(df: DataFrame, by: list[str], score: str, member: str, tie: str, n: int, seed: int = 0) -> DataFrame:
    """by, es, p: the score against n permutations of the members, each a shuffle by seeded hashes."""
    real = gsea_scores(df, by, score, member, tie).select(*by, "es")
    replicates = df.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    w = Window.partitionBy(*by, "__rep")
    shuffled = replicates.withColumn("__k", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "__rep", tie), tie))).withColumn("__m", F.count_if(F.col(member)).over(w)).withColumn(member, F.col("__k") <= F.col("__m"))
    permuted = gsea_scores(shuffled, [*by, "__rep"], score, member, tie).withColumnRenamed("es", "__es")
    return permuted.join(real, by).groupBy(*by, "es").agg(((F.count_if(F.col("__es") >= F.col("es")) + 1) / (F.count("*") + 1)).alias("p"))


def tmm_factors(df: DataFrame, sample: str, gene: str, value: str, reference, logratio_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """sample, factor: log2 of the trimmed mean of ratios to the reference sample, weighted by their precision."""
    total = df.withColumn("__lib", F.sum(value).over(Window.partitionBy(sample)))
    ref = total.filter(F.col(sample) == reference).select(gene, F.col(value).alias("__rv"), F.col("__lib").alias("__rl"))
    both = total.filter(F.col(value) > 0).join(ref.filter("__rv > 0"), gene)
    a, b = F.col(value) / F.col("__lib"), F.col("__rv") / F.col("__rl")
    ratio = both.withColumn("__m", F.log2(a / b)).withColumn("__a", (F.log2(a) + F.log2(b)) / 2)
    variance = (F.col("__lib") - F.col(value)) / F.col("__lib") / F.col(value) + (F.col("__rl") - F.col("__rv")) / F.col("__rl") / F.col("__rv")
    n = F.count("*").over(Window.partitionBy(sample))
    weighted = ratio.withColumn("__w", 1 / variance).withColumn("__n", n)
    ranked = with_rank(with_rank(weighted, "__m", [sample], "__im"), "__a", [sample], "__ia")
    low_m, low_a = F.floor(F.col("__n") * logratio_trim) + 1, F.floor(F.col("__n") * sum_trim) + 1
    kept = ranked.filter(F.col("__im").between(low_m, F.col("__n") + 1 - low_m) & F.col("__ia").between(low_a, F.col("__n") + 1 - low_a))
    factors = kept.groupBy(sample).agg((F.sum(F.col("__m") * F.col("__w")) / F.sum("__w")).alias("factor"))
    return df.select(sample).distinct().join(factors, sample, "left").fillna(0.0, ["factor"])


def mott_trim(df: DataFrame, quality: str, cutoff: float = 0.05) -> DataFrame:
    """The rows with `first`, `last` (exclusive): the run of an array of qualities whose summed lead over the cutoff is
    largest."""
    zero = F.lit(0.0)
    begin = F.struct(zero.alias("sum"), F.lit(0).alias("from"), zero.alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("i"))

    def gain(s, q):
        up = s["sum"] + (F.lit(cutoff) - F.pow(F.lit(10.0), -q.cast("double") / 10))
        return F.struct(up.alias("up"), s["from"].alias("from"), s["best"].alias("best"), s["first"].alias("first"), s["last"].alias("last"), (s["i"] + 1).alias("i"))

    def keep(s):
        good, better = s["up"] > 0, s["up"] > s["best"]
        return F.struct(
            F.when(good, s["up"]).otherwise(0.0).alias("sum"), F.when(good, s["from"]).otherwise(s["i"]).alias("from"), F.greatest(s["best"], s["up"]).alias("best"),
            F.when(better, s["from"]).otherwise(s["first"]).alias("first"), F.when(better, s["i"]).otherwise(s["last"]).alias("last"), s["i"].alias("i"),
        )

    step = lambda s, q: F.element_at(F.transform(F.array(gain(s, q)), keep), 1)
    run = F.aggregate(quality, begin, step)
    return df.withColumn("__run", run).select(*df.columns, F.col("__run.first").alias("first"), F.col("__run.last").alias("last"))
