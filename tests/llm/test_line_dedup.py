import random

import pytest
from pyspark.sql import functions as F

from sparkomics.llm import line_dedup as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        at = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            line.insert(at, rng.choice("abcé"))
        elif line and kind == 1:
            del line[min(at, len(line) - 1)]
        elif line:
            line[min(at, len(line) - 1)] = rng.choice("abcé")
    return "".join(line)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    pairs = [(a, edited(rng, a, rng.randrange(0, 5))) for a in words for _ in range(4)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.when(F.length("a") > 0, F.split("a", "")).otherwise(F.array()).alias("x"), F.when(F.length("b") > 0, F.split("b", "")).otherwise(F.array()).alias("y"))
    for r in df.select("a", "b", L.within(F.col("x"), F.col("y"), threshold).alias("ok")).collect():
        assert r["ok"] == (distance(r["a"], r["b"]) <= threshold), r


def brute(rows, threshold, min_chars, common=L.COMMON):
    """doc -> numbers of dropped lines."""
    docs = [(d, [x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")]) for d, t in rows]
    first, held = {}, {}
    for d, lines in docs:
        key = (d is None, d or 0)
        for x in set(lines):
            first[x] = min(first.get(x, key), key)
            held[x] = held.get(x, 0) + 1
    order = {x: (k, x) for x, k in first.items() if len(x) >= min_chars}
    near = {b for b in order for a in order if order[a] < order[b] and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold}
    out = {}
    for d, lines in docs:
        seen, gone = set(), []
        for i, x in enumerate(lines):
            if len(x) >= min_chars or (x and held[x] >= common):
                if x in near or first[x] != (d is None, d or 0) or x in seen:
                    gone.append(i)
                seen.add(x)
        out[d, "\n".join(lines)] = ",".join(map(str, gone))
    return out


@pytest.mark.parametrize("threshold", [1, 2])
def test_against_brute_force(spark, threshold):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(8, 14))) for _ in range(25)]
    rows = []
    for d in range(40):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 6))]
        rows.append((d if d < 38 else None, "\n".join([*lines, "ab", "ab", *["\tcd \r"] * (d % 5 == 0), rng.choice(["", "ef", "  ef"])])))
    rows += [(50, None), (51, ""), (52, rows[3][1])]
    want = brute(rows, threshold, 8)
    got = L.line_report(spark.createDataFrame(rows, "doc_id long, text string"), threshold, 8).collect()
    assert sorted((r["doc_id"] or -1, r["dropped"]) for r in got) == sorted((d or -1, x) for (d, _), x in want.items())


def test_deduplicated_keeps_columns_and_drops_copies(spark):
    long = "this is a line of more than forty characters, really"
    other = "another line that is long enough to be compared too"
    rows = [
        (1, f"{long}\nshort\n{other}\nshort", "en", "a", 1),
        (2, f"{long[:-1]}Y\nmine alone: this line stands nowhere else at all", "en", "a", 1),
        (3, f"{long}\nshort\n{other}\nshort", "en", "b", 1),
        (4, "short\nshort", "en", "b", 1),
        (5, None, None, None, None),
        (6, "", "en", "b", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lines", F.lit("clash")).withColumn("h", F.lit(0)).withColumn("keep", F.lit(1))
    out = L.deduplicated(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("mine alone: this line stands nowhere else at all", 48), 4: ("short\nshort", 11), 5: (None, None), 6: ("", 0)}


def test_documents_of_short_lines_outlive_a_shared_long_line(spark):
    """Only what is nothing but repeated lines goes, or a whole copy; short lines of a document's own stay."""
    licence = "this licence line of more than forty characters is shared"
    poem, code = "roses are red\nviolets are blue", "def f(x):\n    return x"
    rows = [(1, f"{licence}\nfirst"), (2, f"{poem}\n{licence}"), (3, f"{licence}\n{code}"), (4, f"\n{licence}\n  \t"), (5, f"{poem}\n{licence}"), (None, f"{poem}\n{licence}"), (6, f"{poem}\n{licence}\nmore")]
    out = L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: poem, 3: code, 6: f"{poem}\nmore"}


def test_a_hot_line_and_very_long_ones(spark):
    hot, long = "a line of twenty characters or more that many hold", "".join(random.Random(3).choice("abc d") for _ in range(60_000))
    rows = [(d, f"{hot}\nown {d}") for d in range(500)] + [(600, long), (601, long[:30_000] + "x" + long[30_000:]), (602, "y" + long)]
    got = {r["doc_id"]: r["dropped"] for r in L.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: "" if d in (0, 600) else "0" for d, _ in rows}


@pytest.mark.parametrize("threshold", [1, 2])
def test_hot_segments_lose_no_pair(spark, threshold):
    """Templates whose lines share segments, with buckets of three lines already split, over all levels."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde ") for _ in range(24)) for _ in range(4)]
    lines = {edited(rng, rng.choice(base), rng.choice([0, 1, 1, 2, 3, 5])).strip() for _ in range(200)}
    # Repeats of one letter, and lines with less left than there are segments.
    lines = sorted({x for x in lines if len(x) >= 8} | {"aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaa", "aaaabaaa", "caaaaaaa", "aaaaaaac"})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    names = {(r["h"], r["c"]): r["line"] for r in L.long_lines(docs, 8).collect()}
    told = L.stored(L.distinct_lines(docs, threshold, 8), "split-lines")
    got = {(names[r["a_h"], r["a_c"]], names[r["b_h"], r["b_c"]]) for r in L.edit_pairs(docs, told, threshold, 8, hot=2).collect()}
    assert got == {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold}


def test_a_template_does_not_meet_all_pairs(spark):
    """3,000 lines with one half in common: pairs in proportion to the lines, not to their square."""
    rng = random.Random(12)
    lines = ["the following record was taken at: " + "".join(rng.choice("0123456789") for _ in range(35)) for _ in range(3_000)]
    lines += [lines[0] + "5", lines[1][:-1] + "x"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    told = L.stored(L.distinct_lines(docs), "template-lines")
    assert L.candidates(docs, told).count() < 10 * len(lines)
    got = {r["doc_id"]: r["n_dropped"] for r in L.line_report(docs).collect()}
    assert sorted(d for d, n in got.items() if n) == [3_000, 3_001]


def test_levels_of_hot_segments_are_not_joined_in_one_query(spark, capsys):
    """What a level finds is stored, so that no query holds the joins of all levels."""
    rng = random.Random(13)
    docs = spark.createDataFrame([(d, "the same beginning of many a line " + "".join(rng.choice("ab") for _ in range(20))) for d in range(100)], "doc_id long, text string")
    told = L.stored(L.distinct_lines(docs), "level-lines")
    met = L.candidates(docs, told, hot=2)
    assert met.count() > 0
    met.explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "Join" not in plan and "Generate" not in plan


def test_empty_table(spark):
    assert L.line_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert L.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
