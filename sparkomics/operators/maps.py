"""Maps between identifiers, stored once in buckets of either side, so that lookups both ways leave them where they are."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkomics.operators.ordered import numbered
from sparkomics.operators.storage import shared_dir


class StoredMap(NamedTuple):
    """The names of two tables of source, target and row (the pair's place in its source, from 0): bucketed by either."""

    by_source: str
    by_target: str
    turned: bool = False

    def swapped(self) -> StoredMap:
        """The map the other way round: no row moves."""
        return self._replace(turned=not self.turned)


def store_map(df: DataFrame, source: str, target: str, order: list[str], buckets: int | None = None) -> StoredMap:
    """Store the pairs of two columns, as text; empty text is null. `order` tells rows apart and gives them their numbers.

    Buckets are as many as a shuffle has partitions by default, so that the other side of a join is dealt like the map.
    """
    spark = df.sparkSession
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    rows = numbered(df.withColumn("__source", text(source)).withColumn("__target", text(target)), order, "row")
    rows = rows.select(F.col("__source").alias("source"), F.col("__target").alias("target"), "row")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = []
    for side in ("source", "target"):
        name = f"map_{uuid.uuid4().hex[:12]}_by_{side}"
        path = f"{shared_dir(spark)}/sparkomics-{spark.sparkContext.applicationId}/{name}"
        rows.repartition(n, side).write.bucketBy(n, side).sortBy(side).option("path", path).format("parquet").saveAsTable(name)
        names.append(name)
    return StoredMap(*names)


def look_up(spark: SparkSession, stored: StoredMap, keys: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """The rows of `keys` with `value` and `row` of each pair that has their key on the source side, or, `inverse`, on the
    target side; a key without any gives one row of nulls. The map isn't shuffled."""
    own, other, name = ("target", "source", stored.by_target) if inverse != stored.turned else ("source", "target", stored.by_source)
    table = spark.table(name).select(F.col(own).alias("__key"), F.col(other).alias("value"), "row")
    return keys.join(table, F.col(key).cast("string") == F.col("__key"), "left").drop("__key")


def first_entry(spark: SparkSession, stored: StoredMap, keys: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """The distinct keys with `value` and `row` of the first pair of each."""
    found = look_up(spark, stored, keys.select(key).distinct(), key, inverse)
    return found.groupBy(key).agg(F.min_by(F.struct("value", "row"), "row").alias("x")).select(key, "x.*")


def drop_map(spark: SparkSession, stored: StoredMap) -> None:
    for name in stored[:2]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
