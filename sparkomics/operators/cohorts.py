"""Cohorts: ordered exclusion rules with their attrition, and covariates of visits from the nearest measurement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkomics.operators.ordered import along
from sparkomics.operators.storage import stored


def cascade(df: DataFrame, rules: list[tuple[str, Column]], name: str = "excluded_by") -> DataFrame:
    """The rows with the first of the ordered rules that takes them, null if none does. A rule that is null takes nothing."""
    taken = [F.when(F.coalesce(rule, F.lit(False)), label) for label, rule in rules]
    return df.withColumn(name, F.coalesce(*taken) if taken else F.lit(None).cast("string"))


def eligible(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The rows that no rule takes."""
    return df.filter(~F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for _, r in rules], F.lit(False)), F.lit(False)))


def attrition(df: DataFrame, rules: list[tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """by, step (from 1), rule, matching (rows that the rule would take alone), removed (that it takes in its turn), left: of
    each rule, in one pass over the rows."""
    by = by or []
    told = cascade(df, rules, "__by")
    counts = [F.count("*").alias("__n")]
    for k, (label, rule) in enumerate(rules):
        counts += [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"__m{k}"), F.count_if(F.col("__by") == label).alias(f"__r{k}")]
    sums = told.groupBy(*by).agg(*counts)
    gone = F.lit(0)
    steps = []
    for k, (label, _) in enumerate(rules):
        gone = gone + F.col(f"__r{k}")
        steps.append(F.struct(F.lit(k + 1).alias("step"), F.lit(label).alias("rule"), F.col(f"__m{k}").alias("matching"), F.col(f"__r{k}").alias("removed"), (F.col("__n") - gone).alias("left")))
    return sums.select(*by, F.inline(F.array(*steps)))


def nearest_measurement(visits: DataFrame, measures: DataFrame, by: list[str], at: str, measured_at: str, values: list[str], days: float, side: str = "before", prefix: str = "") -> DataFrame:
    """The visits with `values` of a measurement of the same `by`, and `<prefix>days`, by how many days it is later (earlier:
    negative): of side before the last one up to the visit, of after the first from it on, of either the nearer, the earlier of
    two as near. What is more than `days` away is none; of measurements at one time the first by its values is taken.

    Both tables are sorted into one line by `by` and time, so that a person with many visits is no larger task than others.
    """
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c else None
    own = stored(visits.withColumn("__id", F.monotonically_increasing_id()).withColumn("__at", time(at)), "visits")
    entry = F.struct(F.col("__t").alias("t"), *values)
    measured = measures.withColumn("__t", time(measured_at)).filter("__t IS NOT NULL").groupBy(*by, "__t").agg(F.min(entry).alias("__m"))
    family = F.struct(*by)
    events = measured.select(*by, F.col("__t").alias("__at"), F.lit(1).alias("__kind"), F.lit(-1).cast("long").alias("__id"), F.struct(family.alias("g"), F.col("__m").alias("m")).alias("__m"))
    nothing = F.lit(None).cast(events.schema["__m"].dataType)
    asks = lambda kind: own.filter("__at IS NOT NULL").select(*by, "__at", F.lit(kind).alias("__kind"), "__id", nothing.alias("__m"))
    # A visit asks twice: before the measurements of its time for what follows, behind them for what was.
    line = stored(along(asks(0).unionByName(events).unionByName(asks(2)), [*by, "__at", "__kind", "__id"], last={"__last": F.col("__m")}, first={"__first": F.col("__m")}), "visits-and-measurements")
    mine = lambda c: F.when(F.col(c)["g"].eqNullSafe(family), F.col(c)["m"])
    earlier = line.filter("__kind = 2").select("__id", mine("__last").alias("__earlier"))
    later = line.filter("__kind = 0").select("__id", mine("__first").alias("__later"))
    told = own.join(earlier, "__id", "left").join(later, "__id", "left")
    limit = int(days * 86_400_000_000)
    before = F.when(F.col("__at") - F.col("__earlier")["t"] <= limit, F.col("__earlier"))
    after = F.when(F.col("__later")["t"] - F.col("__at") <= limit, F.col("__later"))
    nearer = F.when(after.isNull() | (F.col("__at") - before["t"] <= after["t"] - F.col("__at")), F.coalesce(before, after)).otherwise(after)
    found = told.withColumn("__found", {"before": before, "after": after}.get(side, nearer))
    return found.select(*visits.columns, *[F.col("__found")[v].alias(f"{prefix}{v}") for v in values], ((F.col("__found")["t"] - F.col("__at")) / 86_400_000_000).alias(f"{prefix}days"))


def covariates(visits: DataFrame, by: list[str], at: str, tables: list[dict]) -> DataFrame:
    """The visits with columns of several tables; each of `tables` has `table` and `values`, and either `on` (columns that
    it shares with the visits, one row for each) or `measured_at`, `days` and `side` of `nearest_measurement`; and a `prefix`."""
    out = visits
    for spec in tables:
        prefix, values = spec.get("prefix", ""), spec["values"]
        if "on" in spec:
            side = spec["table"].select(*[F.col(c).alias(f"__on_{c}") for c in spec["on"]], *[F.col(v).alias(f"{prefix}{v}") for v in values])
            same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__on_{c}") for c in spec["on"]])
            out = out.join(side, same, "left").drop(*[f"__on_{c}" for c in spec["on"]])
        else:
            out = nearest_measurement(out, spec["table"], by, at, spec["measured_at"], values, spec["days"], spec.get("side", "before"), prefix)
    return out
