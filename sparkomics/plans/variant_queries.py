"""Registered queries over variants, made of the rows of `orders` by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkomics.functions import columns as C
from sparkomics.operators import variants as V
from sparkomics.plans.queries import query, t

#: The same variants as columns of DuckDB: alternatives a1 and a2, genotypes g0 and g1 and their quality.
_V = """v AS (SELECT o_orderkey AS pos, o_orderstatus AS chrom, o_custkey AS c, CASE WHEN o_custkey % 7 = 0 THEN 'ACG' ELSE substr('ACGT', CAST(1 + o_orderkey % 4 AS INT), 1) END AS ref,
substr('ACGT', CAST(1 + (o_orderkey + 1 + o_custkey % 2) % 4 AS INT), 1) AS a1, CASE WHEN o_custkey % 3 = 0 THEN substr('ACGT', CAST(1 + (o_orderkey + 2) % 4 AS INT), 1) || 'T' END AS a2,
o_custkey % 5 = 0 AS f10, o_custkey % 11 = 0 AS sv, CASE o_orderkey % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1|1' END AS g0,
CASE WHEN o_custkey % 4 = 0 THEN './.' WHEN o_custkey % 2 = 0 THEN '1/0' ELSE '0|0' END AS g1, (o_orderkey + o_custkey) % 50 AS q0, o_custkey % 50 AS q1 FROM orders),
w AS (SELECT *, chrom || '-' || pos || '-' || ref || '-' || a1 || coalesce('/' || a2, '') AS id, length(ref) = 1 AND a2 IS NULL AS snp, (length(ref) > 1 OR a2 IS NOT NULL) AND NOT sv AS indel FROM v)"""
_TYPE = "CASE WHEN snp THEN 'snp' WHEN indel THEN 'indel' WHEN sv THEN 'sv' ELSE 'unknown' END"
_SUBTYPE = """CASE WHEN snp THEN CASE WHEN ref || a1 IN ('AG', 'GA', 'CT', 'TC') THEN 'ts' ELSE 'tv' END WHEN indel THEN CASE WHEN a2 IS NOT NULL THEN 'unknown' WHEN length(ref) > 1 THEN 'del' ELSE 'ins' END ELSE 'DEL' END"""


def _variants(spark, d) -> DataFrame:
    info = "map_concat(IF(o_custkey % 11 = 0, map('SVTYPE', 'DEL'), map()), map('AN', CAST(o_custkey % 90 + 10 AS STRING), 'AC', concat_ws(',', o_custkey % 10, o_custkey % 7), 'AF', '0.25,0.5', 'AN_Male', '40', 'AN_Female', '60', 'GC_Male', concat_ws(',', o_custkey % 9, o_orderkey % 5, 2, 3, 1, 0), 'GC_Female', concat_ws(',', o_custkey % 6, o_orderkey % 4, 1, 2, 0, 1), 'AN_NFE', '30', 'AF_NFE', '0.5,0.125', 'GC_NFE', concat_ws(',', o_custkey % 3, 1, o_orderkey % 2, 0, 0, 0)))"
    base = "substr('ACGT', CAST(1 + {} % 4 AS INT), 1)"
    call = lambda s, gt, gq: f"named_struct('sample', '{s}', 'fields', map('GT', {gt}, 'GQ', CAST({gq} AS STRING), 'FT', IF({gq} < 5, 'lowq', IF({gq} < 9, 'lowq;q10', ''))))"
    first = call("s0", "CASE o_orderkey % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1|1' END", "(o_orderkey + o_custkey) % 50")
    second = call("s1", "CASE WHEN o_custkey % 4 = 0 THEN './.' WHEN o_custkey % 2 = 0 THEN '1/0' ELSE '0|0' END", "o_custkey % 50")
    return t(spark, d, "orders").selectExpr(
        "o_orderstatus AS chrom", "o_orderkey AS pos", "o_custkey AS c", f"IF(o_custkey % 7 = 0, 'ACG', {base.format('o_orderkey')}) AS ref",
        f"array_compact(array({base.format('(o_orderkey + 1 + o_custkey % 2)')}, IF(o_custkey % 3 = 0, concat({base.format('(o_orderkey + 2)')}, 'T'), NULL))) AS alt",
        "IF(o_custkey % 10 = 0, array('q10', 's50'), IF(o_custkey % 5 = 0, array('q10'), NULL)) AS filter", f"{info} AS info", f"array({first}, {second}) AS genotypes",
    )


def _id():
    return C.legacy_variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("id")


def _gt(i: int):
    return F.try_element_at(F.get("genotypes", i)["fields"], F.lit("GT"))


@query(f"WITH {_V} SELECT id, {_TYPE} AS kind, {_SUBTYPE} AS subtype, indel AND a2 IS NULL AND length(ref) > 1 AS deletion, snp AND ref || a1 IN ('AG', 'GA', 'CT', 'TC') AS transition, pos + length(a1) AS variant_end FROM w")
def variant_types(spark, d):
    ref, alt, info = F.col("ref"), F.col("alt"), F.col("info")
    sv = V.has_sv(info)
    return _variants(spark, d).select(_id(), C.var_type(ref, alt, sv).alias("kind"), C.var_subtype(ref, alt, info).alias("subtype"), C.is_deletion(ref, alt, sv).alias("deletion"), C.is_transition(ref, alt).alias("transition"), C.variant_end(F.col("pos"), alt).alias("variant_end"))


@query(f"WITH {_V} SELECT id FROM w WHERE NOT f10 AND {_TYPE} IN ('snp', 'sv') AND a2 IS NULL AND chrom = 'O' AND pos BETWEEN 100 AND 5000")
def variant_filter(spark, d):
    kept = V.filter_variants(V.in_region(_variants(spark, d), "O", 100, 5000), ["q10"], ["snp", "sv"], 1)
    return kept.select(_id())


@query(f"WITH {_V} SELECT id FROM w WHERE {_SUBTYPE} IN ('ts', 'ins', 'DEL')")
def variant_subtypes(spark, d):
    return V.of_subtypes(_variants(spark, d), ["ts", "ins", "DEL"]).select(_id())


@query(f"""WITH {_V}, x AS (SELECT id, CASE WHEN q0 >= 10 THEN g0 ELSE './.' END AS g0, CASE WHEN q1 >= 10 THEN g1 ELSE './.' END AS g1 FROM w)
SELECT * FROM x WHERE g0 LIKE '%1%' OR g1 LIKE '%1%'""")
def call_quality(spark, d):
    kept = V.filter_calls(_variants(spark, d), "GQ", lambda v: v.try_cast("int") >= 10)
    return kept.select(_id(), _gt(0).alias("g0"), _gt(1).alias("g1"))


@query(f"""WITH {_V}, x AS (SELECT id, q0 >= 9 AS k0, q1 >= 9 AS k1, g0, g1 FROM w WHERE NOT f10)
SELECT id, CAST(k0 AS INT) + CAST(k1 AS INT) AS calls FROM x WHERE (k0 AND g0 LIKE '%1%') OR (k1 AND g1 LIKE '%1%')""")
def call_filters(spark, d):
    return V.drop_filtered(_variants(spark, d), ["q10", "lowq"]).select(_id(), F.size("genotypes").alias("calls"))


@query(f"""WITH {_V}, x AS (SELECT id, unnest([g0, g1]) AS g FROM w)
SELECT id, count(*) FILTER (g IN ('0/0', '0|0')) AS RR, count(*) FILTER (g = '0') AS R, count(*) FILTER (g IN ('0/1', '1/0', '0|1', '1|0')) AS RA, count(*) FILTER (g = '1') AS A,
count(*) FILTER (g IN ('1/1', '1|1')) AS AA, count(*) FILTER (g = './.') AS O FROM x GROUP BY id""")
def variant_text_summary(spark, d):
    return V.text_summary(_variants(spark, d)).select("id", *[F.col(c).cast("long").alias(c) for c in ("RR", "R", "RA", "A", "AA", "O")])


@query(f"""WITH {_V}, x AS (SELECT chrom || '-' || pos || '-' || ref || '-' || unnest(list_filter([a1, a2], lambda a: a IS NOT NULL)) AS variant, unnest(range(1, CASE WHEN a2 IS NULL THEN 2 ELSE 3 END)) AS k, g0, g1 FROM w),
y AS (SELECT variant, k, unnest([g0, g1]) AS g FROM x), z AS (SELECT variant, CASE WHEN k = 1 THEN length(g) - length(replace(g, '1', '')) ELSE 0 END AS n FROM y)
SELECT variant, count(*) FILTER (n = 0) AS RR, count(*) FILTER (n = 1) AS RA, count(*) FILTER (n = 2) AS AA, 0 AS R, 0 AS A FROM z GROUP BY variant""")
def variant_summary(spark, d):
    return V.summary(_variants(spark, d))


@query(f"""WITH {_V}, x AS (SELECT chrom || '-' || pos || '-' || ref || '-' || a1 AS variant, g0, g1 FROM w), y AS (SELECT variant, 's0' AS sample, g0 AS g FROM x UNION ALL SELECT variant, 's1', g1 FROM x)
SELECT variant, sample FROM y WHERE g LIKE '%1%'""")
def variant_carriers(spark, d):
    return V.who_has(_variants(spark, d))


@query(f"""WITH {_V}, x AS (SELECT chrom || '-' || pos || '-' || ref || '-' || a1 AS variant, 1 AS k, g0, g1 FROM w UNION ALL SELECT chrom || '-' || pos || '-' || ref || '-' || a2, 2, g0, g1 FROM w WHERE a2 IS NOT NULL),
y AS (SELECT variant, k, 's0' AS sample, g0 AS g FROM x UNION ALL SELECT variant, k, 's1', g1 FROM x) SELECT variant, sample, CASE WHEN k = 1 THEN length(g) - length(replace(g, '1', '')) ELSE 0 END AS dosage FROM y""")
def genotype_matrix(spark, d):
    return V.genotype_matrix(_variants(spark, d)).withColumn("dosage", F.col("dosage").cast("long"))


@query(f"WITH {_V}, y AS (SELECT id, 's0' AS sample, g0 AS g FROM w UNION ALL SELECT id, 's1', g1 FROM w) SELECT id, sample FROM y WHERE g IN ('0/1', '1/0')")
def heterozygous_carriers(spark, d):
    return V.heterozygous_carriers(_variants(spark, d))


@query(f"WITH {_V} SELECT id, 2 AS ploidy0, g0 LIKE '%|%' AS phased0, g1 LIKE '%|%' AS phased1, [g0, 'x'][1] AS gt0 FROM w")
def call_phases(spark, d):
    put = V.set_format(_variants(spark, d), "PS", lambda g: F.lit("x"))
    return put.select(_id(), C.ploidy(_gt(0)).alias("ploidy0"), C.is_phased(_gt(0)).alias("phased0"), C.is_phased(_gt(1)).alias("phased1"), _gt(0).alias("gt0"))


@query(f"""WITH {_V}, wanted AS (SELECT chrom AS wc, pos AS wp, CASE WHEN c % 2 = 0 THEN lower(a1) ELSE ref END AS wr, CASE WHEN c % 2 = 0 THEN ref WHEN c % 5 = 1 THEN 'N' ELSE lower(a1) END AS wa FROM w)
SELECT id, c % 2 = 0 AS swapped FROM w JOIN wanted ON chrom = wc AND pos = wp WHERE c % 2 = 0 OR c % 5 <> 1""")
def allele_swap(spark, d):
    v = _variants(spark, d)
    even, alt = F.col("c") % 2 == 0, F.lower(F.get("alt", 0))
    wanted = v.select("chrom", "pos", F.when(even, alt).otherwise(F.col("ref")).alias("ref"), F.when(even, F.col("ref")).when(F.col("c") % 5 == 1, "N").otherwise(alt).alias("alt"))
    return V.find_variants(v, wanted).select(_id(), "swapped")


@query(f"""WITH {_V} SELECT id FROM w WHERE c IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def record_subset(spark, d):
    return V.select_records(_variants(spark, d), "c", t(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("c"))).select(_id())


@query(f"""WITH {_V} SELECT id FROM w UNION ALL SELECT id FROM w WHERE f10""")
def variant_union(spark, d):
    v = _variants(spark, d)
    return V.merge([v, v.filter(F.array_contains("filter", "q10"))]).select(_id())


@query(f"""WITH {_V}, x AS (SELECT chrom || '-' || pos || '-' || ref || '-' || a1 AS variant, c, pos, 1 AS k FROM w UNION ALL SELECT chrom || '-' || pos || '-' || ref || '-' || a2, c, pos, 2 FROM w WHERE a2 IS NOT NULL),
y AS (SELECT variant, k, (c % 9 + c % 6)::DOUBLE AS rr, (CASE k WHEN 1 THEN pos % 5 + pos % 4 ELSE 5 END)::DOUBLE AS ra, (CASE k WHEN 1 THEN 3 ELSE 1 END)::DOUBLE AS aa, c, pos FROM x),
z AS (SELECT variant, k, (c % 3)::DOUBLE AS rr, (CASE k WHEN 1 THEN 1 ELSE 0 END)::DOUBLE AS ra, (CASE k WHEN 1 THEN pos % 2 ELSE 0 END)::DOUBLE AS aa FROM y)
SELECT variant, 'ALL' AS population, rr AS RR, 0.0::DOUBLE AS R, ra AS RA, 0.0::DOUBLE AS A, aa AS AA, 100 - 2 * (rr + ra + aa) AS O, CASE k WHEN 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS AF FROM y
UNION ALL SELECT variant, 'NFE', rr, 0.0, ra, 0.0, aa, 30 - 2 * (rr + ra + aa), CASE k WHEN 1 THEN 0.5 ELSE 0.125 END FROM z""")
def population_summary(spark, d):
    return V.population_summary(_variants(spark, d), ["NFE"])
