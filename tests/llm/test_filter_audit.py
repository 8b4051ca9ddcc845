import random
import re
from itertools import permutations

from sparkomics.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, mask string, words int, first string, good string, digest int"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(rows, labels):
    """The contract, document by document and order by order."""
    first, good, toxic = {}, set(), set()
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, q, x in (r for r in labels if r[0] is not None):
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    docs = []
    for d, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        failed += "D" * bool(re.search("[#$%&*|]", t)) + "E" * (d is not None and d > first[t])
        docs.append((lang or "", failed, d in good, d in toxic))
    out, removed_by = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                went = [d for d in left if f in d[1]]
                stays = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in gone)
                only = sum(d[0] == part and d[1] == f for d in docs)
                out[part, "".join(order), step] = (len(stays), len(went), redundant, only, sum(d[2] for d in went), sum(d[3] for d in went))
                removed_by[part, f] = removed_by.get((part, f), 0) + len(went)
                left, gone = stays, gone + went
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[3:10]) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randrange(60 if rng.random() < 0.5 else 4000)) for _ in range(rng.choice([0, 3, 99, 100, 101, 140]))]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words += [rng.choice("#$%&*|")]
        texts.append(rng.choice([" ", "\n", "\x0b  ", "  "]).join(words))
    rows = [(d, rng.choice(texts), rng.choice(["de", "en", "fr", None])) for d in rng.sample(range(1, 500), 200)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (600, None, "en"), (601, "", ""), (602, "x " * 200_000, "long"), rows[0], rows[0], (7_000_000_000, texts[1], "de")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d, _, _ in rows[:150]] + [(rows[0][0], 0, 1), (rows[0][0], 1, 0), (None, 1, 1), (99999, 1, 1)]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = corpus(3)
    docs = spark.createDataFrame([(*r, "y", 1, "z", "w", 2) for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*r, "p") for r in labels], LABELS)
    got = result(A.filter_audit(docs, marks))
    assert got == brute(rows, labels)
    assert len(got) == 120 * 5 * len({r[2] or "" for r in rows})


def test_limits_are_strict(spark):
    exact = " ".join([str(i) for i in range(80)] + ["0"] * 20)  # 100 words, 80 of them different
    capitals = "A" * 10 + "a" * 90
    rows = [(1, exact, "x"), (2, exact + " 0", "x"), (3, capitals, "x"), (4, capitals + "A", "x")]
    masks = {r["doc_id"]: r["mask"] for r in A.document_masks(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)).collect()}
    assert masks == {1: 0, 2: 2, 3: 1, 4: 5}


def test_other_filters_and_empty_table(spark):
    cells = spark.createDataFrame([("p", 0, True, False), ("p", 3, False, True), ("p", 2, True, True)], "part string, mask int, good boolean, toxic boolean")
    assert result(A.audit(cells, "XY")) == {
        ("p", "XY", 1): (2, 1, 0, 0, 0, 1, 1),
        ("p", "XY", 2): (1, 1, 1, 1, 1, 1, 3),
        ("p", "YX", 1): (1, 2, 0, 1, 1, 2, 3),
        ("p", "YX", 2): (1, 0, 1, 0, 0, 0, 1),
    }
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.filter_audit(none, spark.createDataFrame([], LABELS)).count() == 0
