"""Statistics as windows and aggregates; special functions come from `functions.special`.

Ranks and what follows from them are taken over the different values of a group, dealt over buckets of values, and carried
from bucket to bucket by small sums; so a group of any size is spread over many tasks. Tables of SMALL rows or fewer take
one window a group instead, with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkomics.functions.special import chi2_sf, fisher_two_sided, hwe_exact, norm_ppf, t_two_sided

#: The names of the methods.
_ALIASES = {
    "fwer": "bonferroni", "bonferroni": "bonferroni", "holm": "holm", "holm-bonferroni": "holm", "hochberg": "hochberg",
    "fdr": "bh", "bh": "bh", "benjamini_hochberg": "bh", "fdr_bh": "bh",
    "by": "by", "benjamini_yekutieli": "by", "bejamini_yekutieli": "by", "fdr_by": "by",
}
BUCKETS = 64
SMALL = 1_000_000


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that takes nulls as equal; the right side's keys go."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"__r_{c}"])
    return left.join(renamed if on else F.broadcast(renamed), condition, how).drop(*[f"__r_{c}" for c in on])  # without keys: one row


def _small(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() <= SMALL


def ranked_values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, __v (each different value that isn't null), __k (its rows), __b (its bucket), __last (rows of the group up to it)."""
    counts = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__k"))
    edges = counts.agg(F.percentile_approx("__v", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(1000)).alias("__edges"))
    placed = counts.join(F.broadcast(edges)).withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges")  # one row
    sums = placed.groupBy(*by, "__b").agg(F.sum("__k").alias("__size"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    sums = sums.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    within = Window.partitionBy(*by, "__b").orderBy("__v")
    return _join(placed, sums, [*by, "__b"]).withColumn("__last", F.col("__before") + F.sum("__k").over(within)).drop("__before")


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed, or by its asymptotic series, which is exact to double precision over 10,000."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(10_000)).cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k)
    return F.when(n <= 10_000, few).otherwise(F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n))


def p_adjust(df: DataFrame, p: str, by: list[str], method: str = "fwer", n: int | None = None, name: str = "q") -> DataFrame:
    """The rows with adjusted p-values within `by`; null p-values give 1 and count among n. Unknown methods are Bonferroni.

    Equal p-values have equal adjusted ones, so that the step procedures run over the different values.
    """
    method = _ALIASES.get(method.lower(), "bonferroni")
    if method not in ("bonferroni", "by") and _small(df):
        most = F.count("*").over(Window.partitionBy(*by))
        sized = df.withColumn("__m", F.greatest(most, F.lit(n)) if n is not None else most).withColumn("__scale", F.lit(1.0))
        return _stepped(sized, p, by, method, name)
    total = df.groupBy(*by).agg(F.count("*").alias("__m"))
    total = total.withColumn("__m", F.greatest("__m", F.lit(n)) if n is not None else F.col("__m"))
    m, value = F.col("__m").cast("double"), F.col("__v")
    if method == "bonferroni":
        told = _join(df, total, by).withColumn("__q", m * F.col(p).cast("double"))
        return told.withColumn(name, F.when(F.col(p).isNull(), 1.0).otherwise(F.least(F.lit(1.0), "__q"))).drop("__m", "__q")
    total = total.withColumn("__scale", _harmonic(m) if method == "by" else F.lit(1.0))
    if _small(df):
        return _stepped(_join(df, total, by), p, by, method, name)
    last, first = F.col("__last"), F.col("__last") - F.col("__k") + 1
    step = {"holm": (m - first + 1) * value, "hochberg": (m - last + 1) * value}.get(method, F.col("__scale") * m / last * value)
    ranked = _join(ranked_values(df, p, by), total, by).withColumn("__s", step)
    up = method == "holm"  # the largest value so far, else the smallest from the last one down
    extreme, least = (F.max, F.greatest) if up else (F.min, F.least)
    edges = ranked.groupBy(*by, "__b").agg(extreme("__s").alias("__e"))
    order = F.col("__b") if up else F.desc("__b")
    carried = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    edges = edges.withColumn("__carry", extreme("__e").over(carried)).drop("__e")
    within = Window.partitionBy(*by, "__b").orderBy("__v" if up else F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0)
    found = _join(ranked, edges, [*by, "__b"]).select(*by, "__v", F.least(F.lit(1.0), least("__carry", extreme("__s").over(within))).alias("__q"))
    own = df.withColumn("__v", F.col(p).cast("double"))
    return _join(own, found, [*by, "__v"], "left").withColumn(name, F.coalesce("__q", F.lit(1.0))).drop("__q", "__v")


def _stepped(df: DataFrame, p: str, by: list[str], method: str, name: str) -> DataFrame:
    """The step procedures over rows with __m and __scale, in one window a group."""
    every = Window.partitionBy(*by)
    up = every.orderBy(F.asc_nulls_last(p))
    ranked = df.withColumn("__i", F.row_number().over(up))
    i, m, value = F.col("__i"), F.col("__m").cast("double"), F.col(p).cast("double")
    if method == "holm":
        q = F.max((m - i + 1) * value).over(every.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    else:
        step = (m - i + 1) * value if method == "hochberg" else F.col("__scale") * m / i * value
        q = F.min(step).over(every.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, F.when(value.isNull(), 1.0).otherwise(F.least(F.lit(1.0), q))).drop("__i", "__m", "__scale")


def zscore(df: DataFrame, value: str, by: list[str], name: str = "z", sample: bool = False) -> DataFrame:
    """Standardised values within `by`: by the population's deviation, or the sample's."""
    deviation = F.stddev_samp(value) if sample else F.stddev_pop(value)
    groups = df.groupBy(*by).agg(F.avg(value).alias("__mean"), deviation.alias("__sd"))
    return _join(df, groups, by).withColumn(name, F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd")


def running(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """The rows with `cummin` and `cummax` of the values so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cummin", F.min(value).over(w)).withColumn("cummax", F.max(value).over(w))


def with_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """The rows with ranks from 1 in ascending order; ties share their mean. Nulls have none."""
    if _small(df):
        own = F.col(value)
        ties = F.count(own).over(Window.partitionBy(*by, own))
        rank = F.rank().over(Window.partitionBy(*by).orderBy(own.asc_nulls_last()))
        return df.withColumn(name, F.when(own.isNotNull(), rank + (ties - 1) / 2))
    ranks = ranked_values(df, value, by).select(*by, "__v", (F.col("__last") - (F.col("__k") - 1) / 2).alias(name))
    return _join(df.withColumn("__v", F.col(value).cast("double")), ranks, [*by, "__v"], "left").drop("__v")


def rin(df: DataFrame, value: str, by: list[str], name: str = "rin", c: float = 3 / 8) -> DataFrame:
    """Rank-inverse-normal values within `by`."""
    ranked = _join(with_rank(df, value, by, "__rank"), df.groupBy(*by).agg(F.count(value).alias("__m")), by)
    return ranked.withColumn(name, norm_ppf((F.col("__rank") - c) / (F.col("__m") - 2 * c + 1))).drop("__rank", "__m")


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """a, b, r, n, p for every two of the columns, in their order, from one aggregation; p is two-sided."""
    return _correlated(df, [(a, b) for i, a in enumerate(columns) for b in columns[i:]], method)


def correlations_between(df: DataFrame, first: list[str], second: list[str], method: str = "pearson") -> DataFrame:
    """a, b, r, n, p of each column of `first` with each of `second`; rows where either is null don't count."""
    return _correlated(df, [(a, b) for a in first for b in second], method)


def _correlated(df: DataFrame, pairs: list[tuple[str, str]], method: str) -> DataFrame:
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    df = df.select(*columns)
    if method == "spearman":
        for c in columns:
            df = with_rank(df, c, [], f"__rank_{c}")
        df = df.select(*[F.col(f"__rank_{c}").alias(c) for c in columns])
    entry = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"))
    rows = df.agg(F.array(*[entry(a, b) for a, b in pairs]).alias("x")).select(F.inline("x"))
    t = F.sqrt(F.try_divide(F.col("r") * F.col("r") * (F.col("n") - 2), 1 - F.col("r") * F.col("r")))
    return rows.withColumn("p", F.when(F.abs("r") >= 1, 0.0).otherwise(t_two_sided(t, (F.col("n") - 2).cast("double"))))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n of every two levels that occur together."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """v, chi2, p of two categorical columns; v is corrected for bias."""
    cells = contingency(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    rows = cells.groupBy(a).agg(F.sum("n").alias("row"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("col"))
    sums = rows.agg(F.sum("row").alias("total"), F.count("*").alias("r")).join(columns.agg(F.count("*").alias("k")))
    # chi2 = n * (sum of n_ij^2 / (n_i * n_j) - 1): cells that don't occur add nothing.
    part = cells.join(rows, a).join(columns, b).agg(F.sum(F.col("n") * F.col("n") / (F.col("row") * F.col("col"))).alias("part"))
    n, r, k = F.col("total"), F.col("r"), F.col("k")
    chi2 = n * (F.col("part") - 1)
    phi = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    return sums.join(part).select(F.sqrt(F.try_divide(phi, F.least(kc - 1, rc - 1))).alias("v"), chi2.alias("chi2"), chi2_sf(chi2, ((r - 1) * (k - 1)).cast("double")).alias("p"))


def enrichment_tables(edges: DataFrame, term: str, element: str, chosen: DataFrame, universe: DataFrame) -> DataFrame:
    """term, a, b, c, d: elements of the universe in both, in the term alone, in the set alone, in neither.

    `chosen` and `universe` hold `element`. Terms that touch the set are returned.
    """
    within = edges.select(term, element).distinct().join(universe.select(element).distinct(), element, "left_semi")
    picked = chosen.select(element).distinct().join(universe.select(element).distinct(), element, "left_semi")
    totals = universe.select(element).distinct().join(picked.withColumn("__in", F.lit(1)), element, "left").agg(F.count("*").alias("__u"), F.count("__in").alias("__y"))
    counts = within.join(picked.withColumn("__in", F.lit(1)), element, "left").groupBy(term).agg(F.count("__in").alias("a"), F.count("*").alias("__o")).filter("a > 0")
    joined = counts.join(F.broadcast(totals))  # one row
    a, o, y, u = (F.col(c) for c in ("a", "__o", "__y", "__u"))
    return joined.select(term, a, (o - a).alias("b"), (y - a).alias("c"), (u - o - y + a).alias("d"))


def set_enrichment(tables: DataFrame, strict: bool = False) -> DataFrame:
    """The 2x2 tables with odds_ratio and p: Fisher's exact test where a cell is small, else chi-square with Yates'
    correction. A table is small if the lesser cell of its lexicographically smaller row is 5 or less; with `strict`,
    if any cell is."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    first = F.least(F.struct(F.col("a"), F.col("b")), F.struct(F.col("c").alias("a"), F.col("d").alias("b")))
    small = (F.least("a", "b", "c", "d") <= 5) if strict else (F.least(first["a"], first["b"]) <= 5)
    n = a + b + c + d
    off = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    chi2 = F.try_divide(n * off * off, (a + b) * (c + d) * (a + c) * (b + d))
    odds = F.try_divide(a * d, b * c)
    p = F.when(small, fisher_two_sided(a, b, c, d)).otherwise(chi2_sf(chi2, F.lit(1.0)))
    return tables.withColumn("odds_ratio", F.coalesce(odds, F.lit(float("inf")))).withColumn("p", F.coalesce(p, F.lit(1.0)))


def hardy_weinberg(df: DataFrame, by: list[str], genotype: str, alpha: float = 0.001) -> DataFrame:
    """by, n0, n1, n2, p, significant: exact test of genotypes 0, 1, 2."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(genotype) == g).alias(f"n{g}") for g in range(3)])
    return counts.withColumn("p", hwe_exact(F.col("n0"), F.col("n1"), F.col("n2"))).withColumn("significant", F.col("p") < alpha)


def permutation_p(df: DataFrame, by: list[str], statistic: str, permuted: str, side: str = "both", pseudocount: int = 1) -> DataFrame:
    """by, p of a statistic against permuted ones, a row each: the part that exceeds it, strictly on one side."""
    left, right = F.count_if(F.col(permuted) < F.col(statistic)), F.count_if(F.col(permuted) > F.col(statistic))
    inclusive = F.least(F.count_if(F.col(permuted) <= F.col(statistic)), F.count_if(F.col(permuted) >= F.col(statistic)))
    beyond = {"left": left, "right": right}.get(side, inclusive)
    return df.groupBy(*by).agg(((beyond + pseudocount) / (F.count(permuted) + pseudocount)).alias("p"))


def percentile(df: DataFrame, by: list[str], value: str, percent: float = 95, name: str = "threshold") -> DataFrame:
    """The exact percentile, with linear interpolation, within `by`."""
    return df.groupBy(*by).agg(F.percentile(value, percent / 100).alias(name))
