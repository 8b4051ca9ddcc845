"""Registered queries over annotations, pedigrees, linkage, trees and associations, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkomics.functions import columns as C
from sparkomics.operators import association, graphs, linkage, lists, lookups, models, pedigree, stats, tables, trees
from sparkomics.plans.queries import enrichment_sql, query, r6, t

# Scores and regions: part keys as places, brands as chromosomes

_SCORES = "scores AS (SELECT p_brand AS chrom, p_partkey AS pos, substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, substr('ACGT', CAST(1 + (p_partkey + 1) % 4 AS INT), 1) AS alt, p_retailprice AS phred FROM part)"
_REGIONS = "regions AS (SELECT p_brand AS chrom, p_partkey - p_size AS s, CASE WHEN p_partkey % 3 > 0 THEN p_partkey + p_size END AS e FROM part WHERE p_size % 10 = 0)"


def _scores(spark, d):
    return t(spark, d, "part").selectExpr("p_brand AS chrom", "p_partkey AS pos", "substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref", "substr('ACGT', CAST(1 + (p_partkey + 1) % 4 AS INT), 1) AS alt", "p_retailprice AS phred")


def _score_regions(spark, d):
    return t(spark, d, "part").filter("p_size % 10 = 0").selectExpr("p_brand AS chrom", "p_partkey - p_size AS start", "IF(p_partkey % 3 > 0, p_partkey + p_size, NULL) AS end")


@query(f"WITH {_SCORES}, {_REGIONS} SELECT DISTINCT scores.chrom, pos, alt, phred FROM scores JOIN regions ON scores.chrom = regions.chrom AND pos BETWEEN s AND coalesce(e, s)")
def scores_in_regions(spark, d):
    return lookups.scores_in(_scores(spark, d), _score_regions(spark, d), 64)


@query(f"WITH {_SCORES}, {_REGIONS}, x AS (SELECT DISTINCT scores.chrom, pos, alt, phred FROM scores JOIN regions ON scores.chrom = regions.chrom AND pos BETWEEN s AND coalesce(e, s)) SELECT round(quantile_cont(phred, 0.95), 6) AS threshold FROM x")
def score_percentile(spark, d):
    return lookups.score_percentile(_scores(spark, d), _score_regions(spark, d), width=64).select(r6("threshold").alias("threshold"))


@query(f"WITH {_SCORES} SELECT pos, ref, alt, phred FROM scores WHERE chrom = (SELECT min(chrom) FROM scores) AND pos BETWEEN 10 AND 900 AND alt = 'C'")
def scores_at(spark, d):
    chrom = t(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return lookups.scores_at(_scores(spark, d), chrom, 10, 900, "C")


@query(f"""WITH {_SCORES}, genes AS (SELECT n_name AS gene, (SELECT min(p_brand) FROM part) AS chrom, n_nationkey * 40 AS s, n_nationkey * 40 + 30 AS e FROM nation)
SELECT gene, pos, alt FROM scores JOIN genes ON scores.chrom = genes.chrom AND pos BETWEEN greatest(s - 50, 0) AND e + 70 WHERE least(pos % 100 / 100, 1 - pos % 100 / 100) >= 0.1""")
def variants_near_genes(spark, d):
    chrom = t(spark, d, "part").agg(F.min("p_brand")).first()[0]
    genes = t(spark, d, "nation").select(F.col("n_name").alias("gene"), F.lit(chrom).alias("chrom"), (F.col("n_nationkey") * 40).cast("long").alias("start"), (F.col("n_nationkey") * 40 + 30).cast("long").alias("end"))
    found = _scores(spark, d).withColumn("af", F.col("pos") % 100 / 100)
    return lookups.near_genes(found, genes, 50, 70, "af", 0.1, 64).select("gene", "pos", "alt")


@query("""WITH r AS (SELECT o_orderstatus AS chrom, o_custkey AS pos, unnest(['A', 'C']) AS alt, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS rs, o_orderkey AS ss FROM orders), w AS (SELECT 'O' AS chrom, c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'G' END AS alt FROM customer)
SELECT chrom, pos, alt, coalesce('rs' || min(rs), 'ss' || min(ss)) AS name FROM w LEFT JOIN r USING (chrom, pos, alt) GROUP BY ALL""")
def identifiers_at(spark, d):
    records = t(spark, d, "orders").selectExpr("o_orderstatus AS chrom", "o_custkey AS pos", "array('A', 'C') AS alts", "IF(o_orderkey % 3 > 0, o_orderkey, NULL) AS rs", "o_orderkey AS ss")
    wanted = t(spark, d, "customer").selectExpr("'O' AS chrom", "c_custkey AS pos", "IF(c_custkey % 2 = 0, 'A', 'G') AS alt")
    return lookups.identifiers_at(records, wanted)


@query("SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def first_match(spark, d):
    return lookups.first_match(t(spark, d, "customer"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey")


@query("""WITH x AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS n FROM orders)
SELECT c_custkey, o_orderstatus, o_orderkey FROM customer LEFT JOIN (SELECT * FROM x WHERE n = 1) ON o_custkey = c_custkey""")
def complete_identifiers(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderkey")
    return lookups.complete(t(spark, d, "customer"), orders, "c_custkey", ["o_orderstatus", "o_orderkey"])


@query("""WITH x AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus = 'O') AS o, max(o_orderkey) FILTER (o_orderstatus = 'F') AS f FROM x WHERE n = 1 GROUP BY 1""")
def best_orthologs(spark, d):
    hits = t(spark, d, "orders").withColumn("confidence", F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("high"))
    wide = lookups.best_orthologs(hits, "o_custkey", "o_orderstatus", ["O", "F"], ["o_orderkey"], "confidence", "o_orderkey")
    return wide.select("o_custkey", F.col("O.o_orderkey").alias("o"), F.col("F.o_orderkey").alias("f"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey BETWEEN 10 AND 700 AND o_totalprice <= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def associations_query(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("chrom"), F.col("o_custkey").alias("pos"), F.col("o_totalprice").alias("p"), F.col("o_orderpriority").alias("trait"))
    return lookups.associations(rows, "O", 10, 700, 200000, ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query("""WITH x AS (SELECT c_custkey, unnest(string_split(c_custkey || ';' || c_nationkey, ';')) AS pos, unnest(string_split(c_name || ';b', ';')) AS gene, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS p FROM customer WHERE c_custkey % 5 > 0)
SELECT c_custkey, CAST(pos AS BIGINT) AS pos, gene, coalesce(p, 1.0) AS p FROM x""")
def load_associations(spark, d):
    raw = t(spark, d, "customer").selectExpr("c_custkey", "IF(c_custkey % 5 = 0, '1 x 2', concat_ws(';', c_custkey, c_nationkey)) AS pos", "concat(c_name, ';b') AS gene", "IF(c_custkey % 4 > 0, CAST(c_acctbal AS STRING), 'NaN?') AS p")
    return lookups.load_associations(raw, ["pos", "gene"], "p", "pos").select("c_custkey", "pos", "gene", "p")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 ELSE 2 END AS score FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def evidence_strength(spark, d):
    return lookups.at_strength(t(spark, d, "orders"), "o_orderpriority", {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}, 2).select("o_orderkey", "score")


@query("SELECT c_custkey, c_name, n_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_merge(spark, d):
    nation = t(spark, d, "nation").withColumn("c_name", F.lit("other"))
    return lookups.left_merge(t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), nation, "n_nationkey").select("c_custkey", "c_name", "n_nationkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def in_both_tables(spark, d):
    return lookups.in_both(t(spark, d, "customer"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("""WITH v AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS n FROM v)
SELECT coalesce(user_id, c_custkey) AS id, c_name, max(event_type) FILTER (n = 1) AS top_1, max(event_type) FILTER (n = 2) AS top_2 FROM k FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id GROUP BY ALL""")
def counts_with_metadata(spark, d):
    counts = t(spark, d, "events").groupBy(F.col("user_id").alias("id"), "event_type").agg(F.sum("value").alias("v"))
    metadata = t(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), "c_name")
    return lookups.counts_with_metadata(counts, metadata, "id", "event_type", "v", 2)


@query("SELECT p_partkey, 'c' || (p_partkey % 7) AS new_chrom, p_size AS new_start FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size % 2 = 1")
def aligned_regions(spark, d):
    part = t(spark, d, "part")
    lifted = part.filter("p_size % 2 = 0").selectExpr("p_partkey", "concat('chrc', p_partkey % 7) AS chrom", "p_size AS start", "p_size AS end")
    return lookups.aligned(part.select("p_partkey"), lifted, "p_partkey").select("p_partkey", "new_chrom", "new_start")


@query("""WITH x AS (SELECT p_partkey, string_split(p_type, ' ') AS a, CASE WHEN p_partkey % 3 > 0 THEN [p_brand, p_name] ELSE [] END AS b FROM part), y AS (SELECT *, unnest(range(1, greatest(len(a), len(b), 1) + 1)) AS i FROM x)
SELECT p_partkey, a[i] AS types, b[i] AS names FROM y""")
def zip_longest(spark, d):
    part = t(spark, d, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("|")).alias("types"), F.when(F.col("p_partkey") % 3 > 0, F.concat_ws("|", "p_brand", "p_name")).alias("names"))
    return lookups.zip_longest(part, ["types", "names"])


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'O') AS o, min(o_orderkey) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1")
def name_classes(spark, d):
    return lookups.name_classes(t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", ["O", "F"], "o_orderkey").withColumnsRenamed({"O": "o", "F": "f"})


@query("WITH e AS (SELECT DISTINCT user_id AS u, event_type AS i FROM events) SELECT x.i AS a, y.i AS b, count(*) AS n FROM e x JOIN e y ON x.u = y.u AND x.i < y.i GROUP BY ALL")
def co_occurrence(spark, d):
    return lookups.co_occurrence(t(spark, d, "events"), "user_id", "event_type")


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS samples FROM orders GROUP BY 1")
def samples_per_person(spark, d):
    return lookups.samples_per_person(t(spark, d, "orders"), "o_custkey", "o_orderkey").withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


_DNA = "upper(translate(regexp_replace(c_name || c_custkey || 'ACGTTGCAACCGGTT', '[^A-Za-z0-9]', '', 'g'), '0123456789', 'ACGTACGTAC'))"


@query(f"""WITH s AS (SELECT c_custkey, {_DNA} AS seq FROM customer), f AS (SELECT c_custkey, o_orderkey, o_orderkey % 5 + 1 AS s, o_orderkey % 5 + 4 AS e, c_custkey % 2 = 0 AS minus, seq FROM orders JOIN s ON o_custkey = c_custkey),
p AS (SELECT *, CASE WHEN minus THEN reverse(translate(seq[s:e], 'ACGTRYKMSWBVDHNX', 'TGCAYRMKWSVBHDNX')) ELSE seq[s:e] END AS part FROM f)
SELECT c_custkey, string_agg(part, '' ORDER BY CASE WHEN minus THEN -s ELSE s END, part) AS seq FROM p GROUP BY 1""")
def spliced_sequences(spark, d):
    text = F.concat("c_name", F.col("c_custkey").cast("string"), F.lit("ACGTTGCAACCGGTT"))
    seq = F.upper(F.translate(F.regexp_replace(text, "[^A-Za-z0-9]", ""), "0123456789", "ACGTACGTAC"))
    names = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name"), seq.alias("seq"))
    found = t(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS seqid", "'CDS' AS feature", "o_orderkey % 5 + 1 AS start", "o_orderkey % 5 + 4 AS end", "IF(o_custkey % 2 = 0, '-', '+') AS strand", "o_custkey AS parent")
    return lookups.spliced(found, names).withColumnRenamed("parent", "c_custkey")


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b, a.o_orderstatus = b.o_orderstatus AS same FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def same_strand(spark, d):
    orders = t(spark, d, "orders")
    pairs = orders.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return lookups.same_strand(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("strand")), pairs)


# Columns


@query("""SELECT p_partkey, concat_ws(',', least(p_size, 20), 7, least(p_partkey, 20)) AS low, concat_ws(',', greatest(p_size, 3), greatest(7, p_size), greatest(p_partkey, 9)) AS high FROM part""")
def parallel_extremes(spark, d):
    a, b = F.array(F.col("p_size").cast("long"), F.lit(7).cast("long"), "p_partkey"), F.array(F.lit(3).cast("long"), F.col("p_size").cast("long"), F.lit(9).cast("long"))
    return t(spark, d, "part").select("p_partkey", F.concat_ws(",", C.pmin(a, 20).cast("array<string>")).alias("low"), F.concat_ws(",", C.pmax(a, b).cast("array<string>")).alias("high"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 3 AS m, l_linenumber AS mm, l_partkey % 5 AS rep, l_suppkey % 3 AS qi, l_suppkey % 2 AS ti, CAST(l_quantity AS BIGINT) * 3 + l_suppkey % 7 AS ql, CAST(l_quantity AS BIGINT) * 3 + l_partkey % 4 AS tl FROM lineitem)
SELECT l_orderkey, l_linenumber, m + rep // 2 - mm - qi - ti AS score, round(100 - 0.1 * floor(1000 * (mm + qi + floor(3 * ln(1 + greatest(ql - tl, 0)) + 0.5)) / (m + rep + mm)), 6) AS identity FROM x""")
def alignment_scores(spark, d):
    x = t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS BIGINT) * 3 AS m", "CAST(l_linenumber AS BIGINT) AS mm", "l_partkey % 5 AS rep", "l_suppkey % 3 AS qi", "l_suppkey % 2 AS ti", "CAST(l_quantity AS BIGINT) * 3 + l_suppkey % 7 AS ql", "CAST(l_quantity AS BIGINT) * 3 + l_partkey % 4 AS tl")
    c = {"matches": F.col("m"), "mismatches": F.col("mm"), "rep_matches": F.col("rep"), "q_num_insert": F.col("qi"), "t_num_insert": F.col("ti"), "strand": F.lit("+"), "q_start": F.lit(0), "q_end": F.col("ql"), "t_start": F.lit(0), "t_end": F.col("tl"), "t_size": F.lit(10_000), "block_sizes": F.lit("5,900,"), "t_starts": F.lit("0,90,")}
    score, identity = C.psl_scores(c)
    return x.select("l_orderkey", "l_linenumber", score.cast("long").alias("score"), r6(identity).alias("identity"))


@query("""SELECT c_custkey, CASE WHEN c_name LIKE '%/%' OR c_name LIKE '% %' THEN 'm' ELSE 's' END AS by_name, CASE WHEN c_nationkey IN (0, 1, 2) THEN 'a' ELSE 's' END AS by_nation, CASE c_nationkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN '0/0' ELSE '0' END AS empty, c_name[1:3] AS token FROM customer""")
def feature_types(spark, d):
    kind = F.when(F.col("c_nationkey") % 3 == 0, "A").when(F.col("c_nationkey") % 3 == 1, "M").otherwise("Z")
    return t(spark, d, "customer").select("c_custkey", C.feature_type(F.col("c_name")).alias("by_name"), C.feature_type(F.col("c_nationkey").cast("string")).alias("by_nation"), C.empty_value(kind).alias("empty"), C.token(F.concat(F.lit("x-"), F.substring("c_name", 1, 3), F.lit("-y")), 2).alias("token"))


@query("SELECT event_id, upper(translate(props, 'KYWMRS', 'NNNNNN')) AS plain, lower(event_type) = lower(upper(event_type)) AS same, date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') AS days FROM events")
def sequence_columns(spark, d):
    day = C.parse_date(F.date_format("ts", "dd/MM/yyyy"), ["yyyy-MM-dd", "dd/MM/yyyy"])
    return t(spark, d, "events").select("event_id", F.upper(C.without_ambiguity(F.col("props"))).alias("plain"), C.same_sequence(F.col("event_type"), F.upper("event_type")).alias("same"), F.datediff(F.lit("2030-01-01").cast("date"), day).cast("long").alias("days"))


# Pedigrees: customers as members, nations as families


_PED = "ped AS (SELECT c_nationkey::VARCHAR AS fam_id, c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey // 2)::VARCHAR END AS father_id, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey // 3)::VARCHAR END AS mother_id, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'f' END AS gender, c_mktsegment AS seg FROM customer)"


def _ped(spark, d):
    return t(spark, d, "customer").selectExpr("CAST(c_nationkey AS STRING) AS fam_id", "CAST(c_custkey AS STRING) AS id", "IF(c_custkey % 2 = 0, CAST(c_custkey DIV 2 AS STRING), NULL) AS father_id", "IF(c_custkey % 3 = 0, CAST(c_custkey DIV 3 AS STRING), NULL) AS mother_id", "IF(c_custkey % 2 = 0, 'm', 'f') AS gender", "map('seg', c_mktsegment) AS features")


def _flat(ped):
    return ped.select(*pedigree.FIXED, F.try_element_at("features", F.lit("seg")).alias("seg"))


@query(f"WITH {_PED} SELECT * FROM ped WHERE fam_id IN ('1', '7')")
def family_subset(spark, d):
    return _flat(pedigree.subset(_ped(spark, d), ["1", "7"]))


@query(f"WITH {_PED} SELECT fam_id, id, CASE WHEN gender = 'm' THEN 'none' ELSE seg END AS value FROM ped")
def set_feature(spark, d):
    return pedigree.feature(pedigree.set_feature(_ped(spark, d), "seg", F.lit("none"), F.col("gender") == "m"), "seg")


@query(f"WITH {_PED} SELECT fam_id, id, 'X' AS value, seg FROM ped")
def add_feature(spark, d):
    dat = spark.range(1).selectExpr("0 AS idx", "'s' AS ftype", "'seg' AS feature", "false AS masked")
    ped, dat = pedigree.add_feature(_ped(spark, d), dat, "a", "affected")
    return ped.select("fam_id", "id", F.try_element_at("features", F.lit("affected")).alias("value"), F.try_element_at("features", F.lit("seg")).alias("seg"))


@query(f"WITH {_PED}, m AS (SELECT min(id::BIGINT)::VARCHAR AS old FROM ped WHERE fam_id = '3') SELECT fam_id, CASE WHEN fam_id = '3' AND id = old THEN 'new' ELSE id END AS id, CASE WHEN fam_id = '3' AND father_id = old THEN 'new' ELSE father_id END AS father_id, CASE WHEN fam_id = '3' AND mother_id = old THEN 'new' ELSE mother_id END AS mother_id, gender, seg FROM ped, m")
def rename_member(spark, d):
    old = t(spark, d, "customer").filter("c_nationkey = 3").agg(F.min("c_custkey")).first()[0]
    return _flat(pedigree.rename_member(_ped(spark, d), "3", str(old), "new"))


@query(f"WITH {_PED}, m AS (SELECT min(id::BIGINT)::VARCHAR AS old FROM ped WHERE fam_id = '3') SELECT fam_id, id, CASE WHEN fam_id <> '3' OR father_id <> old THEN father_id END AS father_id, CASE WHEN fam_id <> '3' OR mother_id <> old THEN mother_id END AS mother_id, gender, seg FROM ped, m WHERE NOT (fam_id = '3' AND id = old)")
def delete_member(spark, d):
    old = t(spark, d, "customer").filter("c_nationkey = 3").agg(F.min("c_custkey")).first()[0]
    return _flat(pedigree.delete_member(_ped(spark, d), "3", str(old)))


@query(f"WITH {_PED} SELECT * FROM ped WHERE fam_id <> '5' UNION ALL SELECT fam_id, id, NULL, NULL, 'u', seg FROM ped WHERE fam_id = '5' UNION ALL SELECT '99', 'n', NULL, NULL, 'u', 's'")
def add_members(spark, d):
    ped, none = _ped(spark, d), F.lit(None).cast("string")
    changed = ped.filter("fam_id = '5'").withColumns({"father_id": none, "mother_id": none, "gender": F.lit("u")})
    new = spark.range(1).selectExpr("'99' AS fam_id", "'n' AS id", "CAST(NULL AS STRING) AS father_id", "CAST(NULL AS STRING) AS mother_id", "'u' AS gender", "map('seg', 's') AS features")
    return _flat(pedigree.add_members(ped, changed.unionByName(new)))


@query(f"WITH {_PED} SELECT fam_id, count(*) FILTER (father_id IS NULL AND mother_id IS NULL) AS founders FROM ped GROUP BY 1")
def founders_per_family(spark, d):
    return pedigree.founders_per_family(_ped(spark, d))


@query(f"WITH {_PED} SELECT concat_ws(chr(9), fam_id, id, coalesce(father_id, '0'), coalesce(mother_id, '0'), gender, seg, '0/0') AS value FROM ped")
def pedigree_rows(spark, d):
    return pedigree.to_rows(_ped(spark, d), [("s", "seg"), ("m", "marker")])


_MEMBERS = "m AS (SELECT c_nationkey::VARCHAR AS fam_id, c_custkey AS id, c_custkey % 2 AS generation, c_acctbal / 11000 AS percentile FROM customer)"


@query(f"WITH {_MEMBERS} SELECT fam_id, id FROM m WHERE percentile >= 0.8 AND fam_id IN (SELECT fam_id FROM m WHERE percentile >= 0.8 GROUP BY 1 HAVING count(*) FILTER (generation = 0) > 0 AND count(*) FILTER (generation = 1) >= 2)")
def passing_members(spark, d):
    members = t(spark, d, "customer").selectExpr("CAST(c_nationkey AS STRING) AS fam_id", "c_custkey AS id", "c_custkey % 2 AS generation", "c_acctbal / 11000 AS percentile")
    return pedigree.passing_members(members, 0.8).select("fam_id", "id")


# Linkage: parts as markers, line items as families' scores

_LOD = "lod AS (SELECT l_suppkey AS family, p_brand AS chrom, p_partkey AS pos, l_discount * 5 AS lod FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _lod(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("family"), F.col("l_partkey").alias("marker"), (F.col("l_discount") * 5).alias("lod"))
    markers = t(spark, d, "part").select(F.col("p_partkey").alias("marker"), F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"))
    return linkage.placed(rows, markers, "marker")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part")
def marker_order(spark, d):
    return linkage.marker_order(t(spark, d, "part"), "p_brand", "p_partkey").select("p_partkey", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_LOD}, peaks AS (SELECT p_partkey AS cluster, p_brand AS chrom, p_partkey - 30 AS s, p_partkey + 2 * p_size AS e FROM part WHERE p_size % 7 = 0)
SELECT cluster, coalesce(string_agg(DISTINCT family::VARCHAR, ',' ORDER BY family::VARCHAR), '') AS families FROM peaks LEFT JOIN lod ON lod.chrom = peaks.chrom AND pos > s AND pos < e AND lod > 0.3 GROUP BY 1""")
def families_per_peak(spark, d):
    peaks = t(spark, d, "part").filter("p_size % 7 = 0").selectExpr("p_partkey AS cluster", "p_brand AS chrom", "p_partkey - 30 AS start", "p_partkey + 2 * p_size AS end")
    return linkage.families_per_peak(peaks, _lod(spark, d), 0.3, 64).select("cluster", F.array_join(F.sort_array(F.transform("families", lambda x: x.cast("string"))), ",").alias("families"))


@query(f"""WITH {_LOD}, h AS (SELECT * FROM lod WHERE chrom = (SELECT min(p_brand) FROM part)), s AS (SELECT max(pos) FILTER (pos <= 60) AS a, min(pos) FILTER (pos >= 140) AS b FROM h)
SELECT family FROM h, s WHERE pos BETWEEN a AND b GROUP BY 1 HAVING min(lod) >= 0.1""")
def contributing_families(spark, d):
    chrom = t(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return linkage.contributing_families(_lod(spark, d), chrom, 60, 140, 0.1, every=True)


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderkey % 10 AS p0, o_custkey % 10 AS p1, (o_orderkey + o_custkey) % 10 AS p2 FROM orders)
SELECT o_orderkey, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS state FROM x""")
def ibd_states(spark, d):
    pairs = t(spark, d, "orders").selectExpr("1 AS family", "o_custkey AS person1", "o_orderkey AS person2", "'m' AS marker", "CAST(o_orderkey % 10 AS STRING) AS p0", "CAST(o_custkey % 10 AS STRING) AS p1", "CAST((o_orderkey + o_custkey) % 10 AS STRING) AS p2")
    return linkage.ibd_states(pairs).select(F.col("person2").alias("o_orderkey"), "state")


@query("""SELECT o_custkey AS person, o_orderkey AS sibling, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 ELSE 0 END AS m1, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 3 ELSE 0 END AS m2 FROM orders""")
def ibd_with_siblings(spark, d):
    orders = t(spark, d, "orders")
    states = orders.selectExpr("1 AS family", "IF(o_custkey % 2 = 0, o_custkey, -o_orderkey) AS person1", "IF(o_custkey % 2 = 0, -o_orderkey, o_custkey) AS person2", "IF(o_orderkey % 2 = 0, 'm1', 'm2') AS marker", "o_orderkey % 3 AS state")
    found = linkage.ibd_with_siblings(states, orders.selectExpr("1 AS family", "o_custkey AS person", "-o_orderkey AS sibling"), ["m1", "m2"])
    return found.select("person", (-F.col("sibling")).alias("sibling"), "m1", "m2")


@query("WITH p AS (SELECT * FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) SELECT (SELECT max(p_partkey) FROM p WHERE p_partkey <= 77) AS before, (SELECT min(p_partkey) FROM p WHERE p_partkey >= 77) AS after")
def flanking_markers(spark, d):
    part = t(spark, d, "part").select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("marker"))
    return linkage.flanking(part, part.agg(F.min("chrom")).first()[0], 77)


# Trees: a heap of the suppliers of each nation

_TREE = "h AS (SELECT s_nationkey AS tree, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, s_name AS name, s_acctbal AS length FROM supplier), n AS (SELECT tree, CAST(k - 1 AS INT) AS node_id, CASE WHEN k > 1 THEN CAST((k - 2) // 3 AS INT) END AS parent_id, name, length FROM h)"


def _heap(spark, d):
    ranked = association.argsort(t(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", "s_suppkey")
    parent = F.when(F.col("place") > 0, F.floor((F.col("place") - 1) / 3).cast("int"))
    return ranked.select(F.col("s_nationkey").cast("long").alias("tree"), F.col("place").cast("int").alias("node_id"), parent.alias("parent_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("length"), F.col("place").cast("int").alias("ord"), F.lit(0).alias("depth"))


_PATHS = "p AS (SELECT tree, node_id, parent_id, name, length, [node_id] AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.tree, n.node_id, n.parent_id, n.name, n.length, list_append(path, n.node_id) FROM p JOIN n ON n.tree = p.tree AND n.parent_id = p.node_id)"


@query(f"""WITH RECURSIVE {_TREE}, {_PATHS}, s AS (SELECT a.tree, a.node_id, count(*) AS size FROM p a JOIN p b ON b.tree = a.tree AND list_contains(b.path, a.node_id) GROUP BY ALL),
w AS (SELECT tree, node_id, size, len(path) - 1 AS depth, row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS pre FROM p JOIN s USING (tree, node_id))
SELECT tree, node_id, pre, pre + size - 1 - depth AS post, CAST(depth AS INT) AS depth FROM w""")
def tree_walk(spark, d):
    return trees.walks(_heap(spark, d)).select("tree", "node_id", "pre", "post", "depth")


@query(f"""WITH RECURSIVE {_TREE}, {_PATHS}, c AS (SELECT tree, parent_id AS node_id, count(*) AS k, min(node_id) AS first FROM n WHERE parent_id IS NOT NULL GROUP BY ALL),
w AS (SELECT p.*, k, node_id > min(node_id) OVER (PARTITION BY tree, parent_id) AND parent_id IS NOT NULL AS later FROM p LEFT JOIN c USING (tree, node_id)),
x AS (SELECT tree, path AS pos, (CASE WHEN later THEN ',' ELSE '' END) || (CASE WHEN k > 0 THEN '(' ELSE '' END) AS token FROM w
UNION ALL SELECT tree, list_append(path, 1000000), (CASE WHEN k > 0 THEN ')' ELSE '' END) || name || ':' || CAST(CAST(floor(length) AS BIGINT) AS VARCHAR) FROM w)
SELECT tree, string_agg(token, '' ORDER BY pos) || ';' AS newick FROM x GROUP BY tree""")
def newick_texts(spark, d):
    return trees.to_newick(_heap(spark, d).withColumn("length", F.floor("length").cast("double")))


@query(f"""WITH RECURSIVE {_TREE}, c AS (SELECT tree, parent_id AS node_id, count(*) AS k FROM n WHERE parent_id IS NOT NULL GROUP BY ALL), m AS (SELECT n.*, coalesce(k, 0) = 1 AS lone FROM n LEFT JOIN c USING (tree, node_id)),
w AS (SELECT tree, node_id, name, parent_id AS up, length FROM m WHERE NOT lone UNION ALL SELECT w.tree, w.node_id, w.name, m.parent_id, w.length + m.length FROM w JOIN m ON m.tree = w.tree AND m.node_id = w.up WHERE m.lone)
SELECT tree, node_id, up AS parent_id, name, round(length, 6) AS length FROM w WHERE up IS NULL OR (tree, up) IN (SELECT (tree, node_id) FROM m WHERE NOT lone)""")
def collapsed_trees(spark, d):
    return trees.collapse(_heap(spark, d)).select("tree", "node_id", "parent_id", "name", F.round("length", 6).alias("length"))


@query(f"""WITH RECURSIVE {_TREE}, {_PATHS} SELECT tree, p.node_id, name, row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS place FROM p WHERE (tree, node_id) NOT IN (SELECT (tree, parent_id) FROM n WHERE parent_id IS NOT NULL)""")
def tree_leaves(spark, d):
    return trees.leaves(_heap(spark, d))


@query(f"WITH {_TREE}, c AS (SELECT tree, parent_id, count(*) AS k FROM n WHERE parent_id IS NOT NULL GROUP BY ALL) SELECT n.tree, bool_and(coalesce(k, 0) IN (0, 2)) AS binary FROM n LEFT JOIN c ON c.tree = n.tree AND c.parent_id = n.node_id GROUP BY 1")
def binary_trees(spark, d):
    return trees.is_binary(_heap(spark, d)).select("tree", "binary")


@query(f"WITH {_TREE} SELECT a.tree, a.node_id, CASE WHEN EXISTS (SELECT 1 FROM n b WHERE b.tree = a.tree AND b.parent_id = a.node_id) THEN a.name END AS name FROM n a")
def without_leaf_names(spark, d):
    return trees.without_names(_heap(spark, d), internal=False).select("tree", "node_id", "name")


@query(f"""WITH RECURSIVE {_TREE}, {_PATHS}, gone AS (SELECT tree, node_id FROM n WHERE parent_id IS NOT NULL AND name IN (SELECT name FROM n WHERE node_id IN (1, 5)))
SELECT tree, node_id, parent_id, name FROM p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.tree = p.tree AND list_contains(p.path, g.node_id))""")
def pruned_trees(spark, d):
    heap = _heap(spark, d)
    return trees.prune(heap, heap.filter("node_id IN (1, 5)")).select("tree", "node_id", "parent_id", "name")


# Associations


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def correlation_test(spark, d):
    return stats.correlations_between(t(spark, d, "lineitem"), ["l_quantity"], ["l_extendedprice"]).select(r6("r").alias("r"), "n")


@query("""SELECT unnest(['l_quantity', 'l_quantity', 'l_discount', 'l_discount']) AS a, unnest(['l_tax', 'l_extendedprice', 'l_tax', 'l_extendedprice']) AS b,
unnest([round(corr(l_quantity, l_tax), 6), round(corr(l_quantity, l_extendedprice), 6), round(corr(l_discount, l_tax), 6), round(corr(l_discount, l_extendedprice), 6)]) AS r FROM lineitem""")
def correlation_between(spark, d):
    return stats.correlations_between(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_tax", "l_extendedprice"]).select("a", "b", r6("r").alias("r"))


@query("""WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT 'c_mktsegment' AS a, 'c_acctbal' AS b, round(corr(m, c_acctbal), 6) AS statistic FROM customer JOIN m USING (c_mktsegment)
UNION ALL SELECT 'c_acctbal', 'c_nationkey', round(corr(c_acctbal, c_nationkey), 6) FROM customer""")
def associated_columns(spark, d):
    customer = t(spark, d, "customer")
    both = association.associate(customer, "c_mktsegment", "c_acctbal").unionByName(association.associate(customer, "c_acctbal", "c_nationkey"))
    return both.select("a", "b", r6("statistic").alias("statistic"))


def _t_tail(r: str, n: str) -> str:
    """SQL: both tails of a correlation's t test, by the series for whole degrees of freedom; |r| is the sine."""
    even = f"list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(1 - {r} * {r}, k) FOR k IN range(0, ({n} - 2) // 2)])"
    odd = f"coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k) - lgamma(k + 0.5)) * pow(1 - {r} * {r}, k - 0.5) FOR k IN range(1, ({n} - 3) // 2 + 1)]), 0)"
    return f"CASE WHEN {n} % 2 = 0 THEN 1 - abs({r}) * {even} ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * {odd}) END"


@query(f"""WITH v AS (SELECT avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS a, c_acctbal AS b, avg(c_nationkey) OVER (PARTITION BY c_mktsegment) AS c, c_nationkey AS d FROM customer),
pairs AS (SELECT 'c_mktsegment' AS a, 'c_acctbal' AS b, 'category means' AS method, corr(a, b) AS r, count(*) AS n FROM v UNION ALL SELECT 'c_mktsegment', 'c_nationkey', 'category means', corr(c, d), count(*) FROM v
  UNION ALL SELECT 'c_acctbal', 'c_nationkey', 'pearson', corr(b, d), count(*) FROM v),
tests AS (SELECT *, {_t_tail('r', 'n')} AS p FROM pairs), ranked AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM tests)
SELECT a, b, method, round(r, 6) AS statistic, round(p, 6) AS p, round(least(1, min(p * m / i) OVER (ORDER BY i DESC)), 6) AS q FROM ranked""")
def association_matrix(spark, d):
    return association.associations(t(spark, d, "customer"), ["c_mktsegment", "c_acctbal", "c_nationkey"]).select("a", "b", "method", r6("statistic").alias("statistic"), r6("p").alias("p"), r6("q").alias("q"))


@query("""WITH v AS (SELECT c_name, c_mktsegment, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_acctbal AS VARCHAR) END AS balance, CASE WHEN c_custkey % 500 = 7 THEN 'unknown' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer),
long AS (UNPIVOT v ON c_name, c_mktsegment, key, balance, nation INTO NAME "column" VALUE x)
SELECT "column", NOT bool_and(try_cast(trim(x) AS DOUBLE) IS NOT NULL) FILTER (WHERE trim(x) <> '') AS categorical FROM long GROUP BY 1 UNION ALL SELECT 'c_acctbal', false""")
def categorical_columns(spark, d):
    rows = t(spark, d, "customer").selectExpr(
        "c_name", "c_mktsegment", "c_acctbal", "CAST(c_custkey AS STRING) AS key", "IF(c_custkey % 3 = 0, '', CAST(c_acctbal AS STRING)) AS balance", "IF(c_custkey % 500 = 7, 'unknown', CAST(c_nationkey AS STRING)) AS nation"
    )
    return association.is_categorical(rows, rows.columns, numeric_strings=True)


@query(enrichment_sql("""WITH e AS (SELECT DISTINCT p_size, o_custkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT o_custkey, bool_or(coalesce(c_nationkey = 3 AND c_mktsegment = 'BUILDING', false)) AS y FROM e LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT p_size, a, o - a AS b, (SELECT count(*) FROM u WHERE y) - a AS c, (SELECT count(*) FROM u) - o - (SELECT count(*) FROM u WHERE y) + a AS d FROM (SELECT p_size, count(*) FILTER (WHERE y) AS a, count(*) AS o FROM e JOIN u USING (o_custkey) GROUP BY 1) WHERE a > 0""", "p_size", ", description") + " FROM ranked LEFT JOIN (SELECT p_size, min(p_name) AS description FROM part GROUP BY 1) USING (p_size)")
def term_enrichment(spark, d):
    sold = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = sold.select("p_size", "o_custkey").distinct()
    chosen = t(spark, d, "customer").filter("c_nationkey = 3 AND c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    names = t(spark, d, "part").groupBy("p_size").agg(F.min("p_name").alias("description"))
    return association.enrich(edges, "p_size", "o_custkey", chosen, names=names).withColumns({"odds_ratio": r6("odds_ratio"), "p": F.round("p", 7), "q": F.round("q", 7)})


@query("""WITH e AS (SELECT DISTINCT event_type AS g, user_id AS u FROM events), s AS (SELECT g, count(*) AS n FROM e GROUP BY 1), m AS (SELECT x.g AS a, y.g AS b, count(*) AS k FROM e x JOIN e y ON x.u = y.u AND x.g < y.g GROUP BY ALL)
SELECT a, b, round(CASE WHEN k = x.n AND k = y.n THEN 0 ELSE 1 / (log10(k + 1) + 1) END, 6) AS distance FROM m JOIN s x ON x.g = a JOIN s y ON y.g = b""")
def term_distances(spark, d):
    return association.term_distances(t(spark, d, "events"), "event_type", "user_id").withColumn("distance", r6("distance"))


_MATRIX = "c AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, CAST((a.s_suppkey * b.s_suppkey) % 10 AS DOUBLE) / 10 AS r FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey), m AS (SELECT s_nationkey AS module, s_suppkey AS node FROM supplier)"


@query(f"""WITH {_MATRIX}, y AS (SELECT sum(r) AS y FROM c WHERE i <= j), z AS (SELECT module, sum(r) AS z FROM m JOIN c ON node = i GROUP BY 1), x AS (SELECT m.module, sum(r) AS x FROM m JOIN c ON m.node = i JOIN m o ON o.node = j AND o.module = m.module WHERE i <= j GROUP BY 1)
SELECT z.module, round(coalesce(x, 0) / y - (z / (2 * y)) ** 2, 6) AS modularity FROM z LEFT JOIN x ON x.module = z.module, y""")
def module_modularity(spark, d):
    s = t(spark, d, "supplier")
    a, b = s.select("s_nationkey", F.col("s_suppkey").alias("i")), s.select("s_nationkey", F.col("s_suppkey").alias("j"))
    matrix = a.join(b, "s_nationkey").select("i", "j", (F.col("i") * F.col("j") % 10 / 10).alias("r"))
    return association.modularity(matrix, s.select(F.col("s_nationkey").alias("module"), F.col("s_suppkey").alias("node"))).withColumn("modularity", r6("modularity"))


@query("""WITH x AS (SELECT l_returnflag, l_orderkey, l_linenumber, CASE WHEN l_discount < 0.05 THEN abs(l_tax) END AS s FROM lineitem) SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS gene, round(coalesce(s, max(s) OVER (PARTITION BY l_returnflag)), 6) AS score FROM x""")
def gene_rankings(spark, d):
    rows = t(spark, d, "lineitem").withColumn("gene", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return association.rankings(rows, "l_returnflag", "gene", "l_discount", "l_tax").withColumn("score", r6("score"))


@query("SELECT user_id, round(sum(value) / count(*), 6) AS area FROM events GROUP BY 1")
def area_under_curve(spark, d):
    return association.area_under(t(spark, d, "events"), "user_id", "value").withColumn("area", r6("area"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING max(l_discount) > 0) AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_discount) > 0)")
def without_zeros(spark, d):
    return association.without_zeros(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_discount").select("l_orderkey", "l_linenumber")


@query("SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS l_quantity_A, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS l_quantity_N FROM lineitem GROUP BY 1")
def trajectory_table(spark, d):
    return association.trajectory(t(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["l_quantity"], ["A", "N"]).select("l_suppkey", r6("l_quantity_A").alias("l_quantity_A"), r6("l_quantity_N").alias("l_quantity_N"))


@query("SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'N') - avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS l_quantity FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'N') > 0 AND count(*) FILTER (l_returnflag = 'A') > 0")
def sample_axes(spark, d):
    return association.sample_axes(t(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["l_quantity"], "A", "N").withColumn("l_quantity", r6("l_quantity"))


@query("""WITH m AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS x1, avg(l_quantity) FILTER (l_returnflag = 'N') AS x2, avg(l_tax) FILTER (l_returnflag = 'A') AS y1, avg(l_tax) FILTER (l_returnflag = 'N') AS y2 FROM lineitem)
SELECT round((y2 - y1) / (x2 - x1), 4) AS slope FROM m""")
def line_of_effect(spark, d):
    return association.line_of_effect(t(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_tax", "A", "N").select(F.round("slope", 4).alias("slope"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id DESC) - 1 AS place FROM events")
def argsort_descending(spark, d):
    return association.argsort(t(spark, d, "events"), ["event_type"], "value", "event_id", True).select("event_id", F.col("place").cast("long").alias("place"))


# Operators of other modules


@query("""WITH x AS (SELECT user_id, value / sum(value) OVER () AS p, (event_id % 10 + 1) / sum(event_id % 10 + 1) OVER () AS q FROM events WHERE value > 0),
g AS (SELECT user_id, -sum((p + q) / 2 * ln((p + q) / 2)) + sum(p * ln(p)) / 2 + sum(q * ln(q)) / 2 AS js FROM x GROUP BY 1) SELECT user_id, round(js, 6) AS divergence FROM g""")
def divergence(spark, d):
    e = t(spark, d, "events").filter("value > 0")
    total = e.agg(F.sum("value").alias("v"), F.sum(F.col("event_id") % 10 + 1).alias("w"))
    shares = e.join(F.broadcast(total)).select("user_id", (F.col("value") / F.col("v")).alias("p"), ((F.col("event_id") % 10 + 1) / F.col("w")).alias("q"))  # one row
    return tables.jensen_shannon(shares, ["user_id"], "p", "q").select("user_id", r6("divergence").alias("divergence"))


@query("""WITH q AS (SELECT p_partkey, [p_size, p_partkey % 40, 30, p_partkey % 7] AS q FROM part), e AS (SELECT p_partkey, unnest(range(0, 4)) AS a, q FROM q), r AS (SELECT p_partkey, a, unnest(range(a + 1, 5)) AS b, q FROM e),
s AS (SELECT p_partkey, a, b, list_sum(list_transform(q[a + 1:b], lambda x: 0.05 - 10 ** (-x / 10.0))) AS s FROM r) SELECT p_partkey, round(greatest(max(s), 0), 6) AS lead FROM s GROUP BY 1""")
def mott_trimming(spark, d):
    part = t(spark, d, "part").withColumn("q", F.array("p_size", (F.col("p_partkey") % 40).cast("int"), F.lit(30), (F.col("p_partkey") % 7).cast("int")))
    kept = models.mott_trim(part, "q").withColumn("kept", F.slice("q", F.col("first") + 1, F.col("last") - F.col("first")))
    gain = F.aggregate("kept", F.lit(0.0), lambda s, x: s + 0.05 - F.pow(F.lit(10.0), -x.cast("double") / 10))
    return kept.select("p_partkey", r6(F.greatest(gain, F.lit(0.0))).alias("lead"))


# Edges and lists

_EDGES = "e AS (SELECT DISTINCT l_suppkey AS term, l_partkey AS object FROM lineitem)"


def _edges(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("term"), F.col("l_partkey").alias("object"))


@query(f"WITH {_EDGES} SELECT * FROM e WHERE object IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def terms_of_objects(spark, d):
    return graphs.linked_to(_edges(spark, d), t(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("object")), "object", "term")


@query(f"WITH {_EDGES} SELECT * FROM e WHERE term IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 4)")
def objects_of_terms(spark, d):
    return graphs.linked_to(_edges(spark, d), t(spark, d, "supplier").filter("s_nationkey < 4").select(F.col("s_suppkey").alias("term")), "term", "object")


@query("SELECT DISTINCT l_suppkey AS term FROM lineitem")
def distinct_terms(spark, d):
    return graphs.distinct_nodes(_edges(spark, d), "term")


@query("SELECT s_suppkey AS child FROM supplier WHERE s_suppkey // 3 = 2")
def direct_children(spark, d):
    edges = t(spark, d, "supplier").selectExpr("s_suppkey DIV 3 AS parent", "s_suppkey AS child")
    return graphs.children(edges, 2)


@query("""WITH RECURSIVE e AS (SELECT s_suppkey // 3 AS p, s_suppkey AS c FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey // 4, s_suppkey FROM supplier WHERE s_suppkey > 0), r AS (SELECT s_suppkey AS root, s_suppkey AS node, 0 AS depth FROM supplier UNION ALL SELECT root, c, depth + 1 FROM r JOIN e ON p = node WHERE depth < 4),
l AS (SELECT root, node FROM r WHERE node NOT IN (SELECT p FROM e)) SELECT s_suppkey AS root, coalesce(sum(node % 10), 0)::BIGINT AS n FROM supplier LEFT JOIN l ON root = s_suppkey GROUP BY 1""")
def leaf_totals(spark, d):
    s = t(spark, d, "supplier").filter("s_suppkey > 0")
    edges = s.selectExpr("s_suppkey DIV 3 AS parent", "s_suppkey AS child").unionByName(s.selectExpr("s_suppkey DIV 4 AS parent", "s_suppkey AS child"))
    values = s.selectExpr("s_suppkey AS node", "s_suppkey % 10 AS n")
    return graphs.leaf_totals(edges, t(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), values, 4).withColumn("n", F.col("n").cast("long"))


@query("SELECT event_type AS feature, count(*) AS n FROM events GROUP BY 1")
def feature_counts(spark, d):
    return graphs.feature_counts(t(spark, d, "events").withColumnRenamed("event_type", "feature"))


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def last_of_id(spark, d):
    return graphs.last_of_id(t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // CAST(ceil(count(*) OVER (PARTITION BY c_nationkey) / 4) AS BIGINT) AS chunk FROM customer")
def chunks_of(spark, d):
    return lists.chunks_of(t(spark, d, "customer"), ["c_custkey"], ["c_nationkey"], 4).select("c_custkey", F.col("chunk").cast("long").alias("chunk"))


@query("SELECT c_custkey, CAST(c_nationkey = 1 AS INT) AS c_nationkey_1, CAST(c_nationkey = 2 AS INT) AS c_nationkey_2 FROM customer")
def dummy_codes(spark, d):
    return lists.dummies(t(spark, d, "customer"), "c_nationkey", 3).select("c_custkey", "c_nationkey_1", "c_nationkey_2")


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal % 100 DESC, c_custkey LIMIT 50)")
def sorted_rows(spark, d):
    return lists.sort_by(t(spark, d, "customer"), F.col("c_acctbal") % 100, "c_custkey", False).limit(50).select("c_custkey")


@query("SELECT p_partkey, upper(p_name) || upper(p_type) AS joined, p_name[2:5] AS part FROM part")
def sequence_parts(spark, d):
    return t(spark, d, "part").select("p_partkey", F.upper(F.concat("p_name", "p_type")).alias("joined"), F.substring("p_name", 2, 4).alias("part"))


@query("SELECT c_custkey, c_acctbal / power((150 + c_nationkey) / 100, 2) AS bmi FROM customer")
def body_mass(spark, d):
    return t(spark, d, "customer").select("c_custkey", C.body_mass_index(F.col("c_acctbal"), 150 + F.col("c_nationkey")).alias("bmi"))
