"""Reshaping, abundance and differential-expression operators over long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkomics.operators.ordered import along
from sparkomics.operators.storage import stored


def flat(df: DataFrame, fields: list[str], sep: str | None = None, ignore_unequal_rows: bool = False) -> DataFrame:
    """A row for each place of the parallel lists in `fields`, which come first. Delimited strings are split by `sep`.

    Lists of unequal length fail, or are cut to the shortest.
    """
    lists = [F.split(c, F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E"))) if sep else F.col(c) for c in fields]
    sizes = [F.size(x) for x in lists]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    if not ignore_unequal_rows and len(sizes) > 1:
        shortest = F.when(shortest == F.greatest(*sizes), shortest).otherwise(F.raise_error(F.lit("lists of unequal length")).cast("int"))
    zipped = F.arrays_zip(*[F.slice(x, F.lit(1), shortest).alias(c) for x, c in zip(lists, fields)])
    rest = [c for c in df.columns if c not in fields]
    return df.select(*rest, F.explode(zipped).alias("__z")).select(*[F.col(f"__z.{c}").alias(c) for c in fields], *rest)


def expand_categorical(df: DataFrame, column: str, levels: list[str], sep: str = "_") -> DataFrame:
    """The rows with a column of 0 and 1 for each level; null stays null."""
    flag = lambda v: F.when(F.col(column).isNotNull(), (F.col(column) == v).cast("double"))
    return df.select("*", *[flag(v).alias(f"{column}{sep}{v}") for v in levels])


def order_categories(df: DataFrame, category: str, value: str) -> DataFrame:
    """category, code: codes from 0 by the category's mean, ties by name."""
    means = df.groupBy(category).agg(F.avg(value).alias("mean"))
    return means.withColumn("code", F.row_number().over(Window.orderBy("mean", category)) - 1)  # a row for each level


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str], name: str = "") -> DataFrame:
    """Rows of each row key and column value side by side, 0 where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{name}{v}") for v in values])


def relative(df: DataFrame, sample: str, value: str, pseudocount: bool | float = True) -> DataFrame:
    """The rows with `relative`, shares of the sample's sum. The pseudocount is the sample's sum by the largest sum, or a
    constant, or none."""
    w = Window.partitionBy(sample)
    if pseudocount is True:
        sums = df.groupBy(sample).agg(F.sum(value).alias("__sum"))
        df = df.join(F.broadcast(sums.agg(F.max("__sum").alias("__max"))))  # one row
        value_plus = F.col(value) + F.sum(value).over(w) / F.col("__max")
    else:
        value_plus = F.col(value) + (0.0 if pseudocount is False else float(pseudocount))
    out = df.withColumn("__v", value_plus)
    return out.withColumn("relative", F.try_divide(F.col("__v"), F.sum("__v").over(w))).drop("__v", "__max")


def top_taxa(df: DataFrame, sample: str, taxon: str, value: str, n: int) -> DataFrame:
    """sample, taxon, value: the n taxa of the highest mean, and the sum of all others as `Other`."""
    means = df.groupBy(taxon).agg((F.sum(value)).alias("__mean"))
    best = means.orderBy(F.desc("__mean"), taxon).limit(n).withColumn("__rank", F.lit(1))
    named = df.join(F.broadcast(best.select(taxon, "__rank")), taxon, "left").withColumn(taxon, F.when(F.col("__rank").isNotNull(), F.col(taxon)).otherwise("Other"))
    return named.groupBy(sample, taxon).agg(F.sum(value).alias(value))


RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
#: Prefixes of group names by rank.
RANK_PREFIXES = ("k_", "p_", "c_", "o_", "f_", "g_", "s_")


def group_taxa(abundance: DataFrame, taxonomy: DataFrame, sample: str, taxon: str, value: str, level: str = "genus", exclude: list[str] | None = None) -> DataFrame:
    """sample, group, value: sums by the taxon's name at the level, or at the nearest rank above that it has one; taxa
    without any, unknown and excluded ones keep their own."""
    at = RANKS.index(level)
    names = [F.when(F.col(RANKS[k]).isNotNull(), F.concat(F.lit(RANK_PREFIXES[k]), F.col(RANKS[k]))) for k in range(at, -1, -1)]
    own = F.concat(F.lit("t_"), F.col(taxon).cast("string"))
    name = F.when(F.col(taxon).isin(exclude or []), F.col(taxon).cast("string")).otherwise(F.coalesce(*names, own))
    return abundance.join(taxonomy.select(taxon, *RANKS), taxon, "left").withColumn("group", name).groupBy(sample, "group").agg(F.sum(value).alias(value))


def shannon(df: DataFrame, sample: str, value: str, lowest_is_zero: bool = True) -> DataFrame:
    """sample, entropy (natural logarithm) of the sample's shares; its smallest value counts as none."""
    w = Window.partitionBy(sample)
    kept = df.withColumn("__low", F.min(value).over(w)).filter(F.col(value) > F.col("__low")) if lowest_is_zero else df.filter(F.col(value) > 0)
    share = kept.withColumn("__p", F.col(value) / F.sum(value).over(w))
    entropy = share.groupBy(sample).agg((-F.sum(F.col("__p") * F.log("__p"))).alias("entropy"))
    return df.select(sample).distinct().join(entropy, sample, "left").fillna(0.0, ["entropy"])


def partial_shannon(df: DataFrame, sample: str, value: str, tie: str) -> DataFrame:
    """The rows with `entropy` of the values up to theirs, ascending; zeros and less add nothing."""
    w = Window.partitionBy(sample).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0)
    positive = F.when(F.col(value) > 0, F.col(value))
    total, weighted = F.sum(positive).over(w), F.sum(positive * F.log(positive)).over(w)
    return df.withColumn("entropy", F.coalesce(F.greatest(F.log(total) - weighted / total, F.lit(0.0)), F.lit(0.0)))


def divergence(df: DataFrame, item: str, p: str, q: str) -> Column:
    """Kullback-Leibler divergence in bits of shares p from q, as an aggregate; items that either lacks add nothing."""
    return F.sum(F.when((F.col(p) > 0) & (F.col(q) > 0), F.col(p) * F.log2(F.col(p) / F.col(q))))


def jensen_shannon(df: DataFrame, by: list[str], p: str, q: str) -> DataFrame:
    """by, divergence, distance of shares p and q, a row for each item."""
    h = lambda c: F.coalesce(-F.sum(F.when(c > 0, c * F.log(c))), F.lit(0.0))
    middle = (F.col(p) + F.col(q)) / 2
    js = h(middle) - (h(F.col(p)) + h(F.col(q))) / 2
    return df.groupBy(*by).agg(js.alias("divergence"), F.sqrt(F.greatest(js, F.lit(0.0))).alias("distance"))


def log_cpm(df: DataFrame, sample: str, value: str) -> DataFrame:
    """The rows with `cpm`: log2 counts per million, with half a count added."""
    library = F.sum(value).over(Window.partitionBy(sample))
    return df.withColumn("cpm", F.log2(F.col(value) + 0.5) + 6 * F.log2(F.lit(10.0)) - F.log2(library + 1))


def bray_curtis(df: DataFrame, sample: str, item: str, value: str) -> DataFrame:
    """a, b, distance of samples that share an item, a < b: 1 - 2 * sum of lesser values / sum of both samples."""
    cells = df.filter(F.col(value) > 0).groupBy(sample, item).agg(F.sum(value).alias("v"))
    sums = cells.groupBy(sample).agg(F.sum("v").alias("total"))
    x, y = (cells.select(F.col(sample).alias(c), F.col(item).alias("item"), F.col("v").alias(f"v_{c}")) for c in "ab")
    met = x.join(y, "item").filter("a < b").groupBy("a", "b").agg(F.sum(F.least("v_a", "v_b")).alias("shared"))
    for c in "ab":
        met = met.join(sums.select(F.col(sample).alias(c), F.col("total").alias(f"total_{c}")), c)
    return met.select("a", "b", (1 - 2 * F.col("shared") / (F.col("total_a") + F.col("total_b"))).alias("distance"))


def significant(df: DataFrame, q: str = "fdr", fold: str = "logFC", alpha: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """The rows whose q-value is under alpha and whose fold change is over the threshold either way."""
    return df.filter((F.col(q) < alpha) & (F.abs(fold) > threshold))


def contrast_summary(df: DataFrame, contrast: str, q: str = "fdr", fold: str = "logFC", alpha: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """contrast, significant, up, down: counts, contrasts without any included."""
    ok = (F.col(q) < alpha) & (F.abs(fold) > threshold)
    return df.groupBy(contrast).agg(F.count_if(ok).alias("significant"), F.count_if(ok & (F.col(fold) > 0)).alias("up"), F.count_if(ok & (F.col(fold) <= 0)).alias("down"))


def significant_in(df: DataFrame, contrast: str, gene: str, contrasts: list[str], logic: str = "all", **limits) -> DataFrame:
    """Genes significant in all, or any, of the contrasts."""
    hits = significant(df.filter(F.col(contrast).isin(contrasts)), **limits).groupBy(gene).agg(F.count_distinct(contrast).alias("n"))
    return hits.filter(F.col("n") >= (len(contrasts) if logic == "all" else 1)).select(gene)


def compare_contrasts(df: DataFrame, contrast: str, gene: str, first: str, second: str, q: str = "fdr", fold: str = "logFC", alpha: float = 0.05) -> DataFrame:
    """gene, both contrasts' values, and whether they agree, grow stronger or weaker from the first to the second."""
    side = lambda name, tag: df.filter(F.col(contrast) == name).select(gene, F.col(q).alias(f"q_{tag}"), F.col(fold).alias(f"fold_{tag}"))
    both = side(first, "a").join(side(second, "b"), gene)
    a, b = F.col("fold_a"), F.col("fold_b")
    consistent = F.signum(a) == F.signum(b)
    return both.select(
        gene, "q_a", "fold_a", "q_b", "fold_b", consistent.alias("consistent"), (consistent & (F.abs(b) > F.abs(a))).alias("stronger"),
        (consistent & (F.abs(b) < F.abs(a))).alias("weaker"), (b - a).alias("slope"), ((F.col("q_a") < alpha) & (F.col("q_b") < alpha)).alias("both"),
    )


def manhattan_layout(df: DataFrame, chrom: str, pos: str) -> DataFrame:
    """The rows with `x`: their position behind all chromosomes before theirs."""
    ends = df.groupBy(chrom).agg(F.max(pos).alias("__end"))
    w = Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)  # a row for each chromosome
    offsets = ends.withColumn("__offset", F.coalesce(F.sum("__end").over(w), F.lit(0))).drop("__end")
    return df.join(offsets, chrom).withColumn("x", F.col(pos) + F.col("__offset")).drop("__offset")


def reciprocal_best(hits: DataFrame, other: DataFrame, query: str, subject: str, score: str) -> DataFrame:
    """query, subject, score pairs that are each other's best hit; ties go to the smaller subject."""
    best = lambda df: df.groupBy(query).agg(F.min_by(F.struct(subject, score), F.struct(-F.col(score), F.col(subject))).alias("h")).select(query, "h.*")
    a = best(hits)
    b = best(other).select(F.col(query).alias("__q"), F.col(subject).alias("__s"))
    return a.join(b, (F.col(query) == F.col("__s")) & (F.col(subject) == F.col("__q"))).drop("__q", "__s")


def nearest_hits(df: DataFrame, other: DataFrame, key: str, subject: str, by: str, value: str) -> DataFrame:
    """query, subject, score: of each row of df those rows of `other` with the same `by` that may be its best hit, by the score
    -abs(difference of value): without a pair for each two rows. Columns of `other` are `subject`, by and value.

    Both are sorted into one line by `by` and value. On either side the nearest value, with its smallest subject, is the
    best; where the next value on that side is as near by its double, all subjects that are as near are looked up.
    """
    entries = other.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, value).agg(F.min(subject).alias("__s"))
    own = F.struct(by, F.col(value).alias("v"), F.col("__s").alias("s"))
    entries = along(entries, [by, value], before={"__low": own}, after={"__high": own})
    entry = F.struct(F.col(by).alias("g"), F.col(value).alias("v"), F.col("__s").alias("s"), *[F.when(F.col(c)[by] == F.col(by), F.col(c)["v"]).alias(n) for c, n in (("__low", "low"), ("__high", "high"))])
    entries = entries.select(by, value, F.lit(1).alias("__kind"), F.lit(None).cast(df.schema[key].dataType).alias("__q"), entry.alias("__e"))
    asks = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).select(by, value, F.lit(0).alias("__kind"), F.col(key).alias("__q"), F.lit(None).cast(entries.schema["__e"].dataType).alias("__e"))
    line = along(asks.unionByName(entries), [by, value, "__kind", "__q"], last={"__last": F.col("__e")}, first={"__first": F.col("__e")}).filter("__kind = 0")
    side = lambda c, beyond: F.when(F.col(c)["g"] == F.col(by), F.struct(F.col(c)["s"].alias("s"), F.abs(F.col(value) - F.col(c)["v"]).alias("gap"), F.abs(F.col(value) - F.col(c)[beyond]).alias("next")))
    told = line.select(by, value, F.col("__q"), F.array_compact(F.array(side("__last", "low"), side("__first", "high"))).alias("__x"))
    told = told.withColumn("__gap", F.array_min(F.transform("__x", lambda x: x["gap"]))).withColumn("__odd", F.exists("__x", lambda x: (x["gap"] == F.col("__gap")) & (x["next"] == x["gap"])))
    told = stored(told, "nearest-hits")
    hits = told.select("__q", F.explode("__x").alias("__x")).select(F.col("__q"), F.col("__x")["s"].alias("__s"), (-F.col("__x")["gap"]).alias("score"))
    odd = told.filter("__odd").select("__q", by, F.col(value).alias("__v"), "__gap")
    same = odd.join(other.select(by, value, F.col(subject).alias("__s")), by).filter(F.abs(F.col("__v") - F.col(value)) == F.col("__gap"))
    return hits.unionByName(same.select("__q", "__s", (-F.col("__gap")).alias("score"))).select(F.col("__q").alias("query"), F.col("__s").alias("subject"), "score")


def knn_impute(df: DataFrame, key: str, target: str, features: list[str], k: int = 3, strict: bool = True, known: DataFrame | None = None) -> DataFrame:
    """The rows with nulls of `target` filled from the k nearest rows that have it, by distance over `features`: rows of df,
    or of `known` where that is given.

    Rows with the same features have the same neighbours and are as near to others: each different set of features is
    looked up once, among the k smallest keys of each. These are dealt over cells of about equal numbers along the feature
    that parts them best. A row looks in its own and
    both next cells, and again in more than twice as many as long as the k-th distance found exceeds the distance to what
    it hasn't seen; so the neighbours are exact, and rows meet all others only if these are spread so. Rows keep their
    null if a feature is null, or no row has the target. Ties go to the smaller key. Weights fall with distance; without
    `strict` they grow with it and their mean is divided by k once more.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    known = (df if known is None else known).filter(F.col(target).isNotNull() & whole).select(key, target, *features)
    alike = [F.col(c).cast("double").alias(f"__{c}") for c in features]
    same = Window.partitionBy(*[f"__{c}" for c in features]).orderBy("__k")
    have = known.select(F.col(key).alias("__k"), F.col(target).alias("__t"), *alike).withColumn("__n", F.row_number().over(same))
    have = stored(have.filter(F.col("__n") <= k).drop("__n"), "known-rows")
    cells = int(max(1, min(10_000, have.count() // (64 * k))))
    parts = F.array(*[F.lit(i / cells) for i in range(1, max(cells, 2))])
    bounds = have.agg(*[F.percentile_approx(f"__{c}", parts, F.lit(10_000)) for c in features]).first()
    walls_of = [sorted({0.0 if x == 0 else x for x in b or []}) for b in bounds]
    best = max(range(len(features)), key=lambda i: len(walls_of[i]))
    first, edges = f"__{features[best]}", walls_of[best]
    walls = F.array(F.lit(float("-inf")), *map(F.lit, edges), F.lit(float("inf")))  # cell i lies between walls i and i + 1
    cell = F.size(F.filter(walls, lambda w: w < F.col(first))) - 1
    have = have.withColumn("__cell", cell)
    own = [f"__ask_{c}" for c in features]
    asked = df.filter(F.col(target).isNull() & whole).select(*[F.col(c).cast("double").alias(o) for c, o in zip(features, own)]).distinct()
    at = F.size(F.filter(walls, lambda w: w < F.col(own[best]))) - 1
    open_rows, done, ring = stored(asked.withColumn("__ask", F.monotonically_increasing_id()).withColumn("__at", at), "asked-rows"), None, 1
    distance = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(o) - F.col(f"__{c}"), 2) for c, o in zip(features, own)]))
    weight = 1 / (F.col("__d") + 1e-9) if strict else F.col("__d")
    last = len(edges)
    while True:
        low, high = F.greatest(F.col("__at") - ring, F.lit(0)), F.least(F.col("__at") + ring, F.lit(last))
        near = open_rows.withColumn("__cell", F.explode(F.sequence(low, high))).join(have, "__cell").withColumn("__d", distance)
        near = near.withColumn("__n", F.row_number().over(Window.partitionBy("__ask").orderBy("__d", "__k"))).filter(F.col("__n") <= k)
        filled = near.groupBy("__ask").agg(F.try_divide(F.sum(F.col("__t") * weight), F.sum(weight) * (1 if strict else k)).alias("__fill"), F.max("__d").alias("__far"), F.count("*").alias("__found"))
        seen = F.least(F.col(own[best]) - F.element_at(walls, (low + 1).cast("int")), F.element_at(walls, (high + 2).cast("int")) - F.col(own[best]))
        told = open_rows.join(filled, "__ask", "left").withColumn("__sure", (F.coalesce("__found", F.lit(0)) >= k) & (F.col("__far") < seen) | F.lit(ring >= last))
        told = stored(told, "neighbours")
        sure = told.filter("__sure").select(*own, "__fill")
        done = sure if done is None else done.unionByName(sure)
        open_rows = told.filter("NOT __sure").select("__ask", *own, "__at")
        if ring >= last or not open_rows.limit(1).count():
            break
        ring = 2 * ring + 1
    here = reduce(lambda a, b: a & b, [F.col(c).cast("double") == F.col(o) for c, o in zip(features, own)], F.col(target).isNull())
    return df.join(done, here, "left").withColumn(target, F.coalesce(target, "__fill")).select(*df.columns)


def training_columns(df: DataFrame, target: str, values: list[str]) -> list[str]:
    """Those of `values` that a model of `target` may use: without nulls where the target is null, and where it isn't."""
    others = [v for v in values if v != target]
    lacking = df.agg(*[F.max(F.col(v).isNull()).alias(v) for v in others]).first() if others else ()
    return [v for v, lacks in zip(others, lacking) if lacks is False]


def impute(df: DataFrame, key: str, values: list[str], columns: list[str] | None = None, k: int = 3, rounds: int = 10, strict: bool = True) -> DataFrame:
    """The rows with nulls of `columns` (by default all of `values` that have any) filled, column by column, from the k
    nearest rows over the training columns, again and again until a round changes nothing, `rounds` times at most.

    A column that is filled becomes a training column of the next one; from the second round on each is filled from all
    others. The state is stored after each column. Rows learn from rows that have a value of their own; without
    `strict` also from filled ones, themselves included, with weights that grow with distance (see `knn_impute`). A
    column stays as it is while no training column has all values. `key` tells rows apart.
    """
    first = df.select(key, *values)
    if columns is None:
        lacking = first.agg(*[F.max(F.col(v).isNull()).alias(v) for v in values]).first()
        columns = [v for v in values if lacking[v]]
    now = stored(first.withColumns({f"__own_{c}": F.col(c) for c in columns} | {c: F.col(c).cast("double") for c in columns}), "imputed")
    for _ in range(rounds):
        before = now
        for c in columns:
            features = training_columns(now, c, values)
            if features:
                filled = knn_impute(now.withColumn(c, F.col(f"__own_{c}").cast("double")), key, c, features, k, strict, None if strict else now)
                now = stored(filled, "imputed")
        old = before.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__old_{c}") for c in columns])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__old_{c}")) for c in columns], F.lit(True))
        if now.join(old, F.col(key) == F.col("__key")).filter(~same).isEmpty():
            break
    done = now.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(done, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__new_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
