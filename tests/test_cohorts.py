"""Cohorts, stored maps, indexed region files and the readers' rules."""

import random

import pytest
from pyspark.sql import functions as F

from sparkomics.operators import cohorts, maps
from sparkomics.sources import formats as R
from sparkomics.sources import regions


def test_cascade_and_attrition(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 5, 2), ("a", 9, 9), ("b", 1, 9), ("b", 7, 1)], "g string, x int, y int")
    rules = [("small", F.col("x") < 3), ("even", F.col("y") % 2 == 0), ("nine", F.col("y") == 9)]
    assert [r["excluded_by"] for r in cohorts.cascade(df, rules).orderBy("g", "x").collect()] == ["small", "even", "nine", "small", None]
    assert [tuple(r) for r in cohorts.eligible(df, rules).collect()] == [("b", 7, 1)]
    got = {(r["g"], r["step"]): tuple(r)[2:] for r in cohorts.attrition(df, rules, ["g"]).collect()}
    assert got["a", 1] == ("small", 1, 1, 2) and got["a", 3] == ("nine", 1, 1, 0)
    assert got["b", 1] == ("small", 1, 1, 1) and got["b", 3] == ("nine", 1, 0, 1)
    assert [tuple(r)[1:] for r in cohorts.attrition(df, rules).orderBy("step").collect()] == [("small", 2, 2, 3), ("even", 1, 1, 2), ("nine", 2, 1, 1)]


@pytest.mark.parametrize("side", ["before", "after", "either"])
def test_nearest_measurement(spark, side):
    rng = random.Random(len(side))
    visits = [(p, i, rng.randrange(60)) for i in range(60) for p in [rng.choice("abbb")]]
    measures = sorted((p, rng.randrange(60), k) for k in range(25) for p in [rng.choice("abc")])
    day = lambda c: F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, {c})")
    v = spark.createDataFrame([*visits, ("a", 99, None)], "p string, i int, d int").withColumn("at", day("d"))
    m = spark.createDataFrame(measures, "p string, t int, v int").withColumn("when", day("t"))
    got = {r["i"]: (r["m_v"], r["m_days"]) for r in cohorts.nearest_measurement(v, m, ["p"], "at", "when", ["v"], 9, side, "m_").collect()}
    assert got[99] == (None, None)
    for p, i, d in visits:
        near = [(t, k) for q, t, k in measures if q == p and abs(t - d) <= 9 and (side == "either" or (t <= d if side == "before" else t >= d))]
        t = min((t for t, _ in near), key=lambda t: (abs(t - d), t), default=None)
        assert got[i] == ((None, None) if t is None else (min(k for u, k in near if u == t), float(t - d)))


def test_stored_maps(spark):
    df = spark.createDataFrame([(3, "b", "x"), (1, "a", "x"), (2, "a", "y"), (4, "c", ""), (5, None, "z")], "n int, s string, t string")
    m = maps.store_map(df, "s", "t", ["n"], buckets=4)
    keys = spark.createDataFrame([("a",), ("b",), ("q",)], "k string")
    rows = lambda out: sorted((tuple(r) for r in out.collect()), key=str)
    assert rows(maps.look_up(spark, m, keys, "k")) == [("a", "x", 0), ("a", "y", 1), ("b", "x", 2), ("q", None, None)]
    back = spark.createDataFrame([("x",), ("z",)], "k string")
    assert rows(maps.look_up(spark, m, back, "k", inverse=True)) == rows(maps.look_up(spark, m.swapped(), back, "k")) == [("x", "a", 0), ("x", "b", 2), ("z", None, 4)]
    assert rows(maps.first_entry(spark, m, keys, "k")) == [("a", "x", 0), ("b", "x", 2), ("q", None, None)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for inverse, table in ((False, m.by_source), (True, m.by_target)):
            plan = maps.look_up(spark, m, keys, "k", inverse)._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            scan = next(k for k, line in enumerate(lines) if table in line)
            above = []  # operators above the map's scan: those less deeply indented, going up
            depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
            for line in reversed(lines[:scan]):
                own = len(line) - len(line.lstrip(" :+-"))
                if own < depth:
                    above.append(line)
                    depth = own
            assert any("Join" in line for line in above) and not any("Exchange" in line for line in above[: next(k for k, line in enumerate(above) if "Join" in line)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    maps.drop_map(spark, m)


def test_indexed_regions(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice(["chr1", "chr2", "x"]), s, s + rng.choice([0, 3, 400, 90_000]), f"n{i}") for i, s in enumerate(rng.randrange(1, 3_000_000) for _ in range(4000))]
    df = spark.createDataFrame([*rows, (None, 1, 2, "no place")], "seqid string, start long, end long, name string")
    path = str(tmp_path / "out")
    assert regions.write_indexed(df, path, "seqid", "start", "end", files=3, block=2000) == 4000
    every = regions.read_indexed(spark, path)
    assert sorted((r["seqid"], r["start"], r["end"], r["cells"][3]) for r in every.collect()) == sorted(rows)
    asked = [("chr1", 500_000, 510_000), ("x", 1, 40), ("chr2", 2_999_000, 3_100_000), ("none", 1, 10)]
    want = sorted(r for r in rows for q, lo, hi in asked if r[0] == q and r[1] <= hi and r[2] >= lo)
    assert sorted((r["seqid"], r["start"], r["end"], r["cells"][3]) for r in regions.read_indexed(spark, path, asked).collect()) == want
    plan = every.filter("seqid = 'chr1' AND start <= 510000 AND end >= 500000")
    assert sorted(r["cells"][3] for r in plan.collect()) == sorted(r[3] for r in rows if r[0] == "chr1" and r[1] <= 510_000 and r[2] >= 500_000)

    def blocks(*filters):
        reader = regions.RegionReader({"path": path, "split": "1"})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        n = 0
        for part in (p for p in reader.partitions() if p.chunks):
            with open(part.path, "rb") as f:
                n += sum(len(list(regions.open_blocks(f, *c))) for c in part.chunks)
        return n

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    whole, one = blocks(), blocks(EqualTo(("seqid",), "chr1"))
    few = blocks(EqualTo(("seqid",), "chr1"), GreaterThanOrEqual(("end",), 500_000), LessThan(("start",), 510_000))
    assert 0 < few < one / 2 and few < whole / 4 and one < whole and blocks(EqualTo(("seqid",), "none")) == 0
    import gzip

    text = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "out").glob("*.gz")))
    assert len(text.splitlines()) == 4000  # any gzip reader reads them


def test_bins():
    for begin, end in [(0, 1), (16383, 16385), (0, 1 << 29), (5 << 26, (5 << 26) + 9)]:
        assert regions.smallest_bin(begin, end) in set(regions.bins(begin, end))
    assert regions.smallest_bin(0, 1) == 4681 and regions.smallest_bin(0, 1 << 29) == 0 and regions.smallest_bin(16383, 16385) == 585


def write(path, text):
    path.write_text(text)
    return str(path)


def test_pedigree_rules(spark, tmp_path):
    ped = R.read_ped(spark, write(tmp_path / "a.ped", "# made by hand\n1 1 0 0 1 1\n1 2 0 0 2 1\n1 3 1 2 m\n\n1 4 1 2 f\n"), [("A", "x")])
    assert {r["id"]: (r["gender"], r["features"]) for r in ped.collect()} == {"1": ("m", {"x": "1"}), "2": ("f", {"x": "1"}), "3": ("m", {"x": None})}
    short = R.read_ped(spark, write(tmp_path / "b.ped", "alone\n1 1 0 0 1\n"))
    assert short.count() == 0
    dat = R.read_dat(spark, write(tmp_path / "a.dat", "A one\nZ odd\nlonely\nm two\nE\nT after\n"))
    assert [(r["ftype"], r["feature"]) for r in dat.orderBy("idx").collect()] == [("A", "one"), ("S", "odd"), ("M", "two")]


def test_fasta_and_annotation_rules(spark, tmp_path):
    path = write(tmp_path / "a.fa", "junk before\nACGT\n>one first\nAA\n>two\nCC\n>one again\nGG\nTT\n")
    assert sorted(tuple(r)[:3] for r in R.read_fasta(spark, path).collect()) == [("one", "one again", "GGTT"), ("two", "two", "CC")]
    write(tmp_path / "b.fa", "\n>three\nA\n")
    both = R.read_fasta(spark, str(tmp_path / "*.fa"))
    assert sorted(r["name"] for r in both.collect()) == ["one", "three", "two"]
    assert sorted(tuple(r)[:3] for r in R.fasta_records(spark, ["AC", "GT"]).collect()) == [("0", "0", "AC"), ("1", "1", "GT")]
    line = lambda object_id, term, name: "\t".join(["DB", object_id, "s", "", term, "r", "IEA", "", "P", name, *[""] * 6])
    gaf = R.read_gaf(spark, write(tmp_path / "a.gaf", "!gaf\n" + "\n".join([line("o1", "t1", "first"), line("o1", "t1", "second"), line("o2", "t1", "x"), line("o1", "t2", "y")]) + "\n"))
    assert sorted((r["db_o_id"], r["go_id"], r["db_o_name"]) for r in gaf.collect()) == [("o1", "t1", "first"), ("o1", "t2", "y"), ("o2", "t1", "x")]
