"""Operators without a query of their own, and cases that the driver's tables don't have."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkomics.functions import columns as C
from sparkomics.operators import association, graphs, lists, lookups, pedigree, stats, tables, trees
from sparkomics.operators import variants as V
from sparkomics.sources import formats


@pytest.mark.parametrize("name, kind", [("fdr_bh", "bh"), ("fdr_by", "by"), ("bejamini_yekutieli", "by"), ("FDR", "bh"), ("fwer", "bonferroni"), ("holm", "holm"), ("hochberg", "hochberg")])
@pytest.mark.parametrize("small", [0, 1000])
def test_p_adjust_aliases_against_a_plain_version(spark, monkeypatch, name, kind, small):
    monkeypatch.setattr(stats, "SMALL", small)
    rng = random.Random(3)
    p = [rng.choice([0.001, 0.01, 0.02, rng.random(), rng.random() ** 4, 1.0, None]) for _ in range(300)]
    rows = [(i, rng.choice(["a", "b", None]), x) for i, x in enumerate(p)]
    got = {r["i"]: r["q"] for r in stats.p_adjust(spark.createDataFrame(rows, "i int, g string, p double"), "p", ["g"], name).collect()}
    for g in ("a", "b", None):
        mine = [(i, x) for i, y, x in rows if y == g]
        n, known = len(mine), sorted((x, i) for i, x in mine if x is not None)
        scale = sum(1 / k for k in range(1, n + 1)) if kind == "by" else 1
        step = {"bonferroni": lambda k, x: n * x, "holm": lambda k, x: (n - k + 1) * x, "hochberg": lambda k, x: (n - k + 1) * x}.get(kind, lambda k, x: scale * n / k * x)
        q = [step(k, x) for k, (x, _) in enumerate(known, 1)]
        for k in range(1, len(q)):
            if kind == "holm":
                q[k] = max(q[k], q[k - 1])
            elif kind != "bonferroni":
                q[-k - 1] = min(q[-k - 1], q[-k])
        want = {i: min(1, v) for v, (_, i) in zip(q, known)} | {i: 1.0 for i, x in mine if x is None}
        assert all(math.isclose(got[i], v, rel_tol=1e-12) for i, v in want.items())
    assert len(got) == 300


@pytest.mark.parametrize("small", [0, 1000])
def test_ranks_share_their_mean(spark, monkeypatch, small):
    monkeypatch.setattr(stats, "SMALL", small)
    values = [5.0, 1.0, 1.0, None, 7.0, 5.0, 5.0]
    out = stats.with_rank(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v", [], "rank").orderBy("i").collect()
    assert [r["rank"] for r in out] == [4.0, 1.5, 1.5, None, 6.0, 4.0, 4.0]


@pytest.mark.parametrize("features", [["x"], ["x", "y"]])
def test_knn_impute_against_brute_force(spark, features):
    """A skewed feature with an outlier that is far from all others."""
    rng = random.Random(1)
    rows = [(i, math.exp(rng.gauss(0, 2)), rng.random() * 3, rng.random()) for i in range(1500)] + [(2000, 1e9, 0.5, None), (2001, None, 1.0, None)]
    rows = [(i, x, y, None if i % 9 == 0 else v) for i, x, y, v in rows]
    got = {r["i"]: r["v"] for r in tables.knn_impute(spark.createDataFrame(rows, "i int, x double, y double, v double"), "i", "v", features, 3).collect()}
    at = lambda r: r[1 : 1 + len(features)]
    known = [r for r in rows if r[3] is not None and r[1] is not None]
    for r in rows:
        if r[3] is not None or r[1] is None:
            assert got[r[0]] == r[3]
        else:
            near = sorted((math.dist(at(r), at(k)), k[0], k[3]) for k in known)[:3]
            weights = [1 / (d + 1e-9) for d, _, _ in near]
            assert math.isclose(got[r[0]], sum(w * v for w, (_, _, v) in zip(weights, near)) / sum(weights), rel_tol=1e-9)


@pytest.mark.parametrize("features, width", [(["x"], 5), (["x", "y"], 400)])
def test_knn_impute_looks_up_each_set_of_features_once(spark, monkeypatch, features, width):
    """Few different values of the first feature: rows don't meet all others that share it."""
    met, inner = [], tables.stored
    at = lambda r: r[1 : 1 + len(features)]
    monkeypatch.setattr(tables, "stored", lambda df, label: (met.append((label, (out := inner(df, label)).count())), out)[1])
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(5)), float(i % 400), None if i % 3 == 0 else float(i)) for i in range(3000)]
    got = {r["i"]: r["v"] for r in tables.knn_impute(spark.createDataFrame(rows, "i int, x double, y double, v double"), "i", "v", features, 3).collect()}
    sets = len({at(r) for r in rows if r[3] is None})
    assert max(n for label, n in met if label == "neighbours") <= sets < 1000
    if width == 5:
        assert dict(met)["known-rows"] == 3 * 5
    known = [r for r in rows if r[3] is not None]
    for r in rows[:600:3]:
        near = sorted((math.dist(at(r), at(k)), k[0], k[3]) for k in known)[:3]
        weights = [1 / (d + 1e-9) for d, _, _ in near]
        assert math.isclose(got[r[0]], sum(w * v for w, (_, _, v) in zip(weights, near)) / sum(weights), rel_tol=1e-9)


def test_nearest_hits_make_no_row_for_each_pair(spark):
    """One group with ties on both sides, equal values, and values that are told apart from afar by no double."""
    rng = random.Random(3)
    a = [(i, 1 if i % 50 else None, rng.choice([round(rng.uniform(-9, 9), 1), 1e9])) for i in range(300)] + [(900, 2, 1.0), (901, 3, 5.0)]
    b = [(i, rng.choice([1, 1, 2]), rng.choice([round(rng.uniform(-9, 9), 1), 1e-9, 2e-9, 3e-9])) for i in range(300)]
    x, y = spark.createDataFrame(a, "q long, g int, v double"), spark.createDataFrame(b, "s long, g int, v double")
    pairs = [(q, s, abs(v - w)) for q, g, v in a for s, h, w in b if g == h]
    best = {q: min((d, s) for p, s, d in pairs if p == q)[1] for q in {p[0] for p in pairs}}
    back = {s: min((d, q) for q, p, d in pairs if p == s)[1] for s in {p[1] for p in pairs}}
    hits = tables.nearest_hits(x, y, "q", "s", "g", "v").toDF("q", "s", "score")
    other = tables.nearest_hits(y, x, "s", "q", "g", "v").toDF("q", "s", "score")
    got = {(r["q"], r["s"]) for r in tables.reciprocal_best(hits, other, "q", "s", "score").collect()}
    assert got == {(q, s) for q, s in best.items() if back[s] == q} and got
    first = {}
    for r in hits.collect():
        first.setdefault(r["q"], []).append((-r["score"], r["s"]))
    assert {q: min(h)[1] for q, h in first.items()} == best
    narrow = [tables.nearest_hits(z.filter("abs(v) > 0.05 AND v < 100"), w.filter("abs(v) > 0.05 AND v < 100"), k, m, "g", "v").count() for z, w, k, m in ((x, y, "q", "s"), (y, x, "s", "q"))]
    assert max(narrow) <= 2 * 300


def test_full_map_holds_no_pairs_of_a_key(spark):
    rows = lambda seed, n: [(k if (k := random.Random(seed * 1000 + i).randrange(12)) else None, i) for i in range(n)]
    a, b = rows(1, 30) + [(77, 90)], rows(2, 20) + [(88, 91), (88, 92)]
    left, right = spark.createDataFrame(a, "k int, x long"), spark.createDataFrame(b, "k int, y int")
    out = graphs.full_map(left, right, "k")
    want = [(k, x, y) for k, x in a for h, y in b if k == h and k is not None]
    want += [(k, x, None) for k, x in a if k is None or k not in dict(b)] + [(k, None, y) for k, y in b if k is None or k not in dict(a)]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, out.collect()), key=order) == sorted(want, key=order)
    assert out.dtypes == [("k", "int"), ("x", "bigint"), ("y", "int")] and "FullOuter" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["diffex_summary", "sig_any"])
def test_means_at_a_limit_do_not_depend_on_how_rows_are_dealt(spark, tmp_path, name):
    """Sums go by the rows' order in the file, from whatever pieces of it tasks read."""
    import duckdb

    from sparkomics.plans import registry

    duckdb.sql(f"""COPY (SELECT ['A', 'N', 'R'][1 + i % 3] AS l_returnflag, i // 4096 * 170 + hash(i) % 170 AS l_partkey, (hash(i + 1) % 3) / 100 AS l_tax, (hash(i + 7) % 11) / 100 AS l_discount FROM range(60000) r(i))
        TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)""")
    with duckdb.connect() as one:
        one.sql("SET threads = 1")
        one.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
        want = sorted(one.sql(registry.oracle_sql()[name]).fetchall())
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect())) == want, size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pairs_that_share_nothing_are_an_option(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "g string, e int")
    pairs = lambda **o: {(r["a"], r["b"]): r["jaccard"] for r in lists.jaccard(df, "g", "e", **o).collect()}
    assert pairs() == {("a", "a"): 1, ("b", "b"): 1, ("c", "c"): 1, ("a", "c"): 1}
    assert pairs(zeros=True) == pairs() | {("a", "b"): 0, ("b", "c"): 0}
    many = spark.range(lists.MATRIX_GROUPS + 1).select(F.col("id").alias("g"), F.lit(1).alias("e"))
    with pytest.raises(ValueError, match="full matrix"):
        lists.overlap(many, "g", "e", zeros=True)


def test_markers_of_one_and_of_two_columns(spark, tmp_path):
    (tmp_path / "a.ped").write_text("f 1 0 0 1 1/3 1.5 7\nf 2 0 1 2 1 3 2.5 8\nf 3 0 0 2 4 4\n")
    ped = formats.read_ped(spark, str(tmp_path / "a.ped"), [("M", "m"), ("T", "t"), ("C", "c")])
    assert [r["features"] for r in ped.orderBy("id").collect()] == [{"m": "1/3", "t": "1.5", "c": "7"}, {"m": "1/3", "t": "2.5", "c": "8"}, {"m": "4/4", "t": None, "c": None}]
    pedigree.write_ped(ped, [("M", "m"), ("T", "t"), ("C", "c")], str(tmp_path / "out"))
    again = formats.read_ped(spark, str(tmp_path / "out"), [("M", "m"), ("T", "t"), ("C", "c")])
    assert [r["features"]["m"] for r in again.orderBy("id").collect()] == ["1/3", "1/3", "4/4"]
    assert [r["father_id"] for r in again.collect()] == [None] * 3


def test_feature_lists(spark, tmp_path):
    dat = spark.createDataFrame([(0, "M", "m", False), (1, "T", "t", False)], "idx int, ftype string, feature string, masked boolean")
    ped = spark.createDataFrame([("f", "1", None, None, "1", {"m": "1/1"})], "fam_id string, id string, father_id string, mother_id string, gender string, features map<string,string>")
    ped, dat = pedigree.add_feature(ped, dat, "A", "ill")
    dat = pedigree.set_type(pedigree.mask(dat, "m"), "t", "C")
    assert [tuple(r) for r in dat.orderBy("idx").collect()] == [(0, "M", "m", True), (1, "C", "t", False), (2, "A", "ill", False)]
    assert ped.first()["features"] == {"m": "1/1", "ill": "X"}
    pedigree.write_dat(dat, str(tmp_path / "dat"))
    assert [r["feature"] for r in formats.read_dat(spark, str(tmp_path / "dat" / "part*")).orderBy("idx").collect()] == ["m", "t", "ill"]


def newick(spark, tmp_path, text):
    (tmp_path / "t.nwk").write_text(text)
    return formats.read_newick(spark, str(tmp_path / "t.nwk"))


def text_of(df):
    return trees.to_newick(df).first()["newick"]


def test_tree_edits(spark, tmp_path):
    tree = newick(spark, tmp_path, "((A:1,(B:2,C:3):4)x:1,D:5,E:6);")
    assert text_of(tree) == "((A:1,(B:2,C:3):4)x:1,D:5,E:6);"
    assert text_of(trees.name_internal(tree)) == "((A:1,(B:2,C:3)internal_2:4)x:1,D:5,E:6)internal_1;"
    assert text_of(trees.prune(tree, ["B", "D"])) == "((A:1,(C:3):4)x:1,E:6);"
    assert text_of(trees.prune(tree, ["A", "E"], inverse=True)) == "((A:1,:4)x:1,E:6);"
    assert text_of(trees.collapse(trees.prune(tree, ["B", "D"]))) == "((A:1,C:7)x:1,E:6);"
    assert text_of(trees.resolve_polytomies(tree)) == "((A:1,(B:2,C:3):4)x:1,(E:6,D:5):0);"
    assert trees.is_binary(trees.resolve_polytomies(tree)).first()["binary"] and not trees.is_binary(tree).first()["binary"]
    assert text_of(trees.without_lengths(trees.without_names(tree, leaves=False))) == "((A,(B,C)),D,E);"
    walked = {r["name"]: (r["pre"], r["post"]) for r in trees.walks(tree).collect()}
    assert walked["x"] == (1, 4) and walked["A"] == (2, 0) and walked["E"] == (7, 6)
    assert [r["name"] for r in trees.children(tree, 0).orderBy("ord").collect()] == ["x", "D", "E"]


def test_subtypes_of_structural_variants(spark):
    rows = [("A", ["<DEL>"], {"SVTYPE": "DEL"}), ("A", ["<DUP>"], {"SVTYPE": "XX", "IMPRECISE": None}), ("A", ["N[2:3["], {"SVTYPE": "BND"}), ("AC", ["A"], {}), ("A", ["."], {}), ("A", ["ACC"], {}), ("A", ["G"], {}), ("A", ["C"], {}), ("A", ["C", "G"], {})]
    df = spark.createDataFrame(rows, "ref string, alt array<string>, info map<string,string>")
    assert [r[0] for r in df.select(C.var_subtype(F.col("ref"), F.col("alt"), F.col("info"))).collect()] == ["DEL", "DUP", "complex", "del", "del", "ins", "ts", "tv", "unknown"]


def test_tables_of_different_samples_do_not_merge(spark):
    make = lambda s: spark.createDataFrame([("1", 5, "A", ["C"], [(s, {"GT": "0/1"})])], "chrom string, pos int, ref string, alt array<string>, genotypes array<struct<sample:string,fields:map<string,string>>>")
    assert V.merge([make("x"), make("x")]).count() == 2
    with pytest.raises(ValueError, match="different samples"):
        V.merge([make("x"), make("y")])


def test_sexes_in_population_counts(spark):
    info = {"GC_Male": "4,3,0", "GC_Female": "1,2,3", "AN_Male": "10", "AN_Female": "14", "AC": "5", "AN": "9", "AF": "0.5"}
    df = spark.createDataFrame([(c, 1, "A", ["C"], info) for c in ("X", "Y", "7")], "chrom string, pos int, ref string, alt array<string>, info map<string,string>")
    got = {r["variant"][0]: tuple(r[k] for k in ("RR", "R", "RA", "A", "AA", "O")) for r in V.population_summary(df, []).collect()}
    assert got == {"X": (1, 4, 2, 3, 3, 24 - 19), "Y": (0, 4, 0, 5, 0, 24 - 9), "7": (5, 0, 5, 0, 3, 24 - 26)}


def test_protein_alignments(spark):
    c = {k: F.lit(v) for k, v in dict(matches=90, mismatches=3, rep_matches=5, q_num_insert=1, t_num_insert=2, strand="+", q_start=0, q_end=100, t_start=0, t_end=330, t_size=400, block_sizes="10,100,", t_starts="0,30,").items()}
    score, identity = C.psl_scores(c)
    row = spark.range(1).select(score.alias("s"), identity.alias("i")).first()
    assert row["s"] == 3 * (90 + 2) - 9 - 1 - 2 and math.isclose(row["i"], 100 - 0.1 * math.floor(1000 * (9 + 1) / (3 * 98)))


def test_lookups_of_one_place(spark):
    scores = spark.createDataFrame([("1", 5, "A", "C", 1.0), ("1", 5, "A", "G", 2.0), ("1", 7, "A", "C", 3.0), ("1", 7, "T", "C", 4.0)], "chrom string, pos int, ref string, alt string, phred double")
    assert [r["phred"] for r in lookups.scores_at(scores, "1", 5, alt="G").collect()] == [2.0]
    assert lookups.scores_at(scores, "1", 7, alt="C").count() == 0 and lookups.scores_at(scores, "1", 5, 7, "C").count() == 3


def test_text_that_reads_as_numbers(spark):
    df = spark.createDataFrame([("1", "a", True), (" 2.5", "", False), ("x", "b", None)], "n string, t string, b boolean").withColumn("n", F.when(F.col("n") != "x", F.col("n")))
    out = association.coerce(df, ["n", "t", "b"])
    assert dict(out.dtypes) == {"n": "double", "t": "string", "b": "boolean"} and [r["t"] for r in out.collect()] == ["a", None, "b"]


def test_walks_end_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent int, child int")
    roots = spark.createDataFrame([(1,)], "node int")
    assert {(r["node"], r["depth"]) for r in graphs.descendants(edges, roots, 9).collect()} == {(2, 1), (3, 2)}
