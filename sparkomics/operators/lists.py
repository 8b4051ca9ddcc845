"""List and set operators over rows: frequencies, groups, overlaps, chunks.

Every operator that depends on order takes the columns that define it; ties must be broken by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups that a full matrix of pairs may have.
MATRIX_GROUPS = 2000


def freq(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows by key."""
    return df.groupBy(key).agg(F.count("*").alias(name))


def qerf(df: DataFrame, key: str) -> DataFrame:
    """n, items: the keys of each frequency, sorted."""
    return freq(df, key).groupBy("n").agg(F.sort_array(F.collect_list(key)).alias("items"))


def group(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, items: the values of each key, sorted."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("items"))


def uniq(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def which(array: Column, predicate, complement: bool = False) -> Column:
    """Positions, from 0, of the elements that satisfy the predicate, or of those that don't."""
    flagged = F.transform(array, lambda x, i: F.struct(i.alias("i"), F.coalesce(predicate(x), F.lit(False)).alias("ok")))
    return F.transform(F.filter(flagged, lambda x: ~x["ok"] if complement else x["ok"]), lambda x: x["i"])


def fingerprint(array: Column, every: bool = False) -> Column:
    """md5 of an array's elements joined as strings: of all, or of all but the last ten."""
    kept = array if every else F.filter(array, lambda _, i: i < F.size(array) - 10)
    return F.md5(F.concat_ws("", F.transform(kept, lambda x: x.cast("string"))))


def overlap(df: DataFrame, group: str, element: str, zeros: bool = False) -> DataFrame:
    """a, b, shared, n_a, n_b for a <= b: sizes of intersections of the groups' sets.

    The pairs come from joining elements, so that their number is bounded by what groups share. With `zeros` pairs that
    share nothing are there too, a full matrix, which up to MATRIX_GROUPS groups can have.
    """
    pairs = df.select(F.col(group).alias("g"), F.col(element).alias("e")).filter("g IS NOT NULL AND e IS NOT NULL").distinct()
    sizes = pairs.groupBy("g").agg(F.count("*").alias("n"))
    met = pairs.alias("x").join(pairs.alias("y"), F.expr("x.e = y.e AND x.g <= y.g")).groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b")).agg(F.count("*").alias("shared"))
    a, b = (sizes.select(F.col("g").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    if zeros:
        groups = sizes.limit(MATRIX_GROUPS + 1).count()
        if groups > MATRIX_GROUPS:
            raise ValueError(f"over {MATRIX_GROUPS} groups: no full matrix")
        return F.broadcast(a).join(b, F.expr("a <= b")).join(met, ["a", "b"], "left").fillna(0, ["shared"]).select("a", "b", "shared", "n_a", "n_b")
    return met.join(a, "a").join(b, "b").select("a", "b", "shared", "n_a", "n_b")


def jaccard(df: DataFrame, group: str, element: str, zeros: bool = False) -> DataFrame:
    """a, b, jaccard of every two groups that share an element, or with `zeros` of all, a <= b."""
    return overlap(df, group, element, zeros).select("a", "b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def venn_regions(df: DataFrame, group: str, element: str, groups: list[str]) -> DataFrame:
    """mask, n: elements in exactly the groups whose place has a 1."""
    member = [F.max((F.col(group) == g).cast("int")) for g in groups]
    masks = df.filter(F.col(group).isin(groups)).groupBy(element).agg(F.concat(*[m.cast("string") for m in member]).alias("mask"))
    return masks.groupBy("mask").agg(F.count("*").alias("n"))


def chunks(df: DataFrame, order: list[str], by: list[str], size: int) -> DataFrame:
    """The rows with the number, from 0, of their chunk of at most `size` rows within `by`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def argrank(df: DataFrame, by: list[str], value: str, tie: str, place: int = 0) -> DataFrame:
    """The row of each group whose value is the highest but `place`; ties go to the smaller `tie`."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == place + 1).drop("__n")


def flatten(df: DataFrame, array: str, name: str = "item") -> DataFrame:
    """A row for each element of an array column."""
    return df.withColumn(name, F.explode(array)).drop(array)


def multimax(frames: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The largest value of each cell over several frames of one shape."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(*keys).agg(F.max(value).alias(value))


def sort_by(df: DataFrame, value: Column, tie: str, ascending: bool = True) -> DataFrame:
    """The rows in the order of a value of theirs; rows of one value stay in the order of `tie`."""
    return df.orderBy(value.asc() if ascending else value.desc(), tie)


def chunks_of(df: DataFrame, order: list[str], by: list[str], n: int) -> DataFrame:
    """The rows with the number, from 0, of their chunk: `n` chunks within `by`, the last ones shorter."""
    w = Window.partitionBy(*by)
    step = F.ceil(F.count("*").over(w) / n)
    return df.withColumn("chunk", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / step))


def dummies(df: DataFrame, code: str, levels: int) -> DataFrame:
    """The rows with a column of 0 and 1 for each code of an ordinal column from 0, but the first."""
    return df.select("*", *[(F.col(code) == k).cast("int").alias(f"{code}_{k}") for k in range(1, levels)])


def random_draws(df: DataFrame, seed: int, normal: bool = True, name: str = "draw") -> DataFrame:
    """The rows with a draw of the standard normal, or of the uniform distribution on [0, 1)."""
    return df.withColumn(name, F.randn(seed) if normal else F.rand(seed))
