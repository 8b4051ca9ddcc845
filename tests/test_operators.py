"""Registered queries against DuckDB on the smallest tables, and operators against hand-derived values."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkomics.functions import special
from sparkomics.operators import lists, ranges, stats, tables
from sparkomics.plans import registry
from sparkomics.streaming.events import windowed_freq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def values(df):
    cell = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else v
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_merge_ends_with_the_last_interval(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), ("a", 5, 7), ("a", 9, 12)], "s string, start int, end int")
    assert [tuple(r) for r in ranges.merge_regions(df, "s", "start", "end").orderBy("start").collect()] == [("a", 1, 7), ("a", 9, 12)]
    assert [tuple(r) for r in ranges.merge_regions(df, "s", "start", "end", strict=True).collect()] == [("a", 1, 12)]


def test_interpolation(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (2.0, 4.0)], "x double, y double").withColumn("g", F.lit(1))
    asked = spark.createDataFrame([(i, x) for i, x in enumerate((-1.0, 0.0, 1.0, 2.0, 3.0))], "i int, x double").withColumn("g", F.lit(1))
    assert [r["y"] for r in ranges.interpolate(curve, asked, ["g"], "x", "y").orderBy("i").collect()] == [0.0, 0.0, 2.0, 4.0, 4.0]


def test_special_functions(spark):
    row = spark.range(1).select(
        special.norm_ppf(F.lit(0.975)).alias("a"), special.chi2_sf(F.lit(3.841458820694124), F.lit(1.0)).alias("b"), special.chi2_sf(F.lit(18.307038053275146), F.lit(10.0)).alias("c"),
        special.t_two_sided(F.lit(2.2281388519649385), F.lit(10.0)).alias("d"), special.fisher_two_sided(*map(F.lit, (3.0, 1.0, 1.0, 3.0))).alias("e"), special.hwe_exact(F.lit(298), F.lit(489), F.lit(213)).alias("f"),
    ).first()
    want = (1.959963984540054, 0.05, 0.05, 0.05, 34 / 70, 0.6556635)
    assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(row, want)), row


def test_p_adjust_nulls_and_n(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, None), (4, 0.04)], "id int, p double")
    q = lambda method, n=None: [r["q"] for r in stats.p_adjust(df, "p", [], method, n).orderBy("id").collect()]
    assert q("fdr") == [0.04, 0.04, 1.0, pytest.approx(0.16 / 3)]
    assert q("odd") == [0.04, 0.08, 1.0, 0.16] and q("bonferroni", 10) == [0.1, 0.2, 1.0, 0.4]


def test_flat_and_lists(spark):
    df = spark.createDataFrame([(1, "a|b", "c|d"), (2, "e", "f|g")], "k int, x string, y string")
    assert [tuple(r) for r in tables.flat(df, ["x", "y"], "|", True).orderBy("k", "x").collect()] == [("a", "c", 1), ("b", "d", 1), ("e", "f", 2)]
    with pytest.raises(Exception, match="unequal"):
        tables.flat(df, ["x", "y"], "|").collect()
    array = spark.createDataFrame([(list(range(12)),)], "a array<int>")
    assert array.select(lists.fingerprint(F.col("a"))).first()[0] == "96a3be3cf272e017046d1b2674a52bd3"


def test_taxa_and_divergence(spark):
    ranks = "taxon int, kingdom string, phylum string, `class` string, `order` string, family string, genus string, species string"
    taxonomy = spark.createDataFrame([(1, "K", "P", None, None, "F", "G", None), (2, "K", "P", None, None, "F", None, None)], ranks)
    found = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 3.0), ("s", 9, 1.0)], "sample string, taxon int, v double")
    assert {r["group"]: r["v"] for r in tables.group_taxa(found, taxonomy, "sample", "taxon", "v").collect()} == {"g_G": 2.0, "f_F": 3.0, "t_9": 1.0}
    shares = spark.createDataFrame([(1, 1.0, 0.0), (1, 0.0, 1.0)], "k int, p double, q double")
    assert math.isclose(tables.jensen_shannon(shares, ["k"], "p", "q").first()["divergence"], math.log(2))


def test_windowed_freq(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:07:00", "b"), ("2024-01-01 02:00:00", "z")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = windowed_freq(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "k", "5 minutes")
    q = out.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["n"]) for r in spark.sql("SELECT * FROM counts").collect()} >= {("a", 2), ("b", 1)}
