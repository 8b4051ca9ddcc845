"""Associations between columns, enrichment of annotations, networks and modules, rankings and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkomics.operators import stats
from sparkomics.operators.storage import stored


def is_categorical(df: DataFrame, columns: list[str], numeric_strings: bool = False) -> DataFrame:
    """column, categorical: whether its values are text or logical. With `numeric_strings`, text that always reads as a
    number isn't."""
    kinds = dict(df.dtypes)

    def told(c: str) -> Column:
        if kinds[c] not in ("string", "boolean"):
            return F.lit(False)
        if kinds[c] == "boolean" or not numeric_strings:
            return F.lit(True)
        return ~F.coalesce(F.bool_and(F.when(F.trim(c) != "", F.trim(c).try_cast("double").isNotNull())), F.lit(False))

    # Literals alone make no aggregate: the count does.
    rows = df.agg(F.count("*").alias("__n"), *[told(c).alias(c) for c in columns])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("categorical")) for c in columns])))


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with text columns that always read as numbers as doubles, the other text columns blank to null."""
    numeric = {r["column"] for r in is_categorical(df, columns, True).collect() if not r["categorical"]}
    from sparkomics.functions.columns import cast_float, cast_str

    kinds = dict(df.dtypes)
    return df.select(*[(cast_float(F.col(c)) if c in numeric else cast_str(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def associate(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, method, statistic, p: Cramer's V of two categorical columns, the correlation of two numeric ones, or the
    correlation ratio of a category's means."""
    kinds = dict(df.dtypes)
    text = [kinds[c] in ("string", "boolean") for c in (a, b)]
    names = [F.lit(a).alias("a"), F.lit(b).alias("b")]
    if all(text):
        return stats.cramers_v(df, a, b).select(*names, F.lit("cramers_v").alias("method"), F.col("v").alias("statistic"), "p")
    if not any(text):
        return stats.correlations_between(df, [a], [b]).select("a", "b", F.lit("pearson").alias("method"), F.col("r").alias("statistic"), "p")
    category, value = (a, b) if text[0] else (b, a)
    known = df.select(category, F.col(value).cast("double").alias("__v")).dropna()
    means = known.groupBy(category).agg(F.avg("__v").alias("__m"))
    coded = known.join(means, category)
    return stats.correlations_between(coded, ["__m"], ["__v"]).select(*names, F.lit("category means").alias("method"), F.col("r").alias("statistic"), "p")


def associations(df: DataFrame, columns: list[str], method: str = "fdr") -> DataFrame:
    """a, b, method, statistic, p, q of every two of the columns."""
    parts = [associate(df, a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stats.p_adjust(stored(out, "associations"), "p", [], method)


def enrich(edges: DataFrame, term: str, element: str, chosen: DataFrame, background: DataFrame | None = None, names: DataFrame | None = None, method: str = "fdr") -> DataFrame:
    """term, a, b, c, d, odds_ratio, p, q and, with `names` (term, description), a description: all terms that touch the
    chosen elements, against the background or, without one, all annotated elements."""
    universe = edges.select(element) if background is None else background
    # The rows of terms are read several times.
    tested = stored(stats.set_enrichment(stats.enrichment_tables(edges, term, element, chosen, universe)), "enrichment")
    tested = stats.p_adjust(tested, "p", [], method)
    return tested if names is None else tested.join(names.select(term, "description"), term, "left")


def term_distances(edges: DataFrame, term: str, element: str) -> DataFrame:
    """a, b, distance of terms that share elements, a < b: 1 / (log10(shared + 1) + 1), 0 of equal sets."""
    from sparkomics.operators.lists import overlap

    same = (F.col("shared") == F.col("n_a")) & (F.col("shared") == F.col("n_b"))
    return overlap(edges, term, element).filter("a < b").select("a", "b", F.when(same, 0.0).otherwise(1 / (F.log10(F.col("shared") + 1) + 1)).alias("distance"))


def modularity(matrix: DataFrame, modules: DataFrame, sigma: float | None = None) -> DataFrame:
    """module, modularity from a symmetric matrix in rows of i, j, r, and modules in rows of module, node: the part of all
    weights within the module, less the squared part of its nodes. With `sigma`, weighted by the module's mean weight."""
    upper = matrix.filter("i <= j")
    total = upper.agg(F.sum("r").alias("all_weight"))
    rows = modules.join(matrix, F.col("node") == F.col("i")).groupBy("module").agg(F.sum("r").alias("touching"))
    inside = modules.join(upper, F.col("node") == F.col("i")).join(modules.select(F.col("module").alias("__m"), F.col("node").alias("__n")), (F.col("module") == F.col("__m")) & (F.col("j") == F.col("__n")))
    within = inside.groupBy("module").agg(F.sum("r").alias("inside"))
    size = modules.groupBy("module").agg(F.count("*").alias("n"))
    told = size.join(rows, "module").join(within, "module", "left").fillna(0.0, ["inside"]).join(F.broadcast(total))  # one row
    value = F.col("inside") / F.col("all_weight") - F.pow(F.col("touching") / (2 * F.col("all_weight")), F.lit(2.0))
    if sigma is not None:
        import math

        weight = F.when(F.col("n") > 1, 1 + 2 * F.col("inside") / (math.exp(1 / sigma**2) * F.col("n") * (F.col("n") - 1))).otherwise(1.0)
        value = weight * value
    return told.select("module", value.alias("modularity"))


def rankings(df: DataFrame, contrast: str, gene: str, q: str = "fdr", fold: str = "logFC", alpha: float = 0.05, direction: str | None = None) -> DataFrame:
    """contrast, gene, score for running sums: the fold change of significant genes, by its size or one direction, and the
    contrast's largest score for all others."""
    value = F.when(F.col(q) < alpha, F.col(fold).cast("double"))
    score = {"up": -value, "down": value}.get(direction, F.abs(value))
    known = df.filter(F.col(gene).isNotNull()).select(contrast, gene, score.alias("score"))
    most = known.groupBy(contrast).agg(F.max("score").alias("__most"))
    return known.join(most, contrast).select(contrast, gene, F.coalesce("score", "__most").alias("score"))


def area_under(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, area: the mean of the values along a curve."""
    return df.groupBy(by).agg((F.sum(value) / F.count("*")).alias("area"))


def without_zeros(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """The cells of rows and columns that have any value above 0."""
    some = lambda c: df.groupBy(c).agg(F.max(value).alias("__most")).filter("__most > 0").select(c)
    return df.join(some(row), row, "left_semi").join(some(column), column, "left_semi").select(*df.columns)


def trajectory(df: DataFrame, index: str, condition: str, components: list[str], conditions: list[str]) -> DataFrame:
    """index and a column `<component>_<condition>` for each of both: the mean of a sample's component in a condition."""
    cell = lambda c, k: F.avg(F.when(F.col(condition) == k, F.col(c))).alias(f"{c}_{k}")
    return df.groupBy(index).agg(*[cell(c, k) for c in components for k in conditions])


def sample_axes(df: DataFrame, index: str, condition: str, components: list[str], first: str, second: str) -> DataFrame:
    """index and, for each component, the way of a sample from the first to the second condition."""
    wide = trajectory(df, index, condition, components, [first, second])
    return wide.select(index, *[(F.col(f"{c}_{second}") - F.col(f"{c}_{first}")).alias(c) for c in components]).dropna()


def line_of_effect(df: DataFrame, condition: str, x: str, y: str, first: str, second: str) -> DataFrame:
    """slope, intercept of the line through both conditions' centres in two components."""
    mean = lambda c, k: F.avg(F.when(F.col(condition) == k, F.col(c)))
    row = df.agg(*[mean(c, k).alias(f"{n}{i}") for n, c in (("x", x), ("y", y)) for i, k in ((1, first), (2, second))])
    slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    return row.select(slope.alias("slope"), (F.col("y1") - slope * F.col("x1")).alias("intercept"))


def argsort(df: DataFrame, by: list[str], value: str, tie: str, decreasing: bool = False) -> DataFrame:
    """The rows with `place`, from 0; descending order is the ascending one reversed, ties too."""
    order = [F.desc(value), F.desc(tie)] if decreasing else [F.asc(value), F.asc(tie)]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)

