import hashlib
import random

from sparkomics.llm import fill_middle as M

SCHEMA = "doc_id long, text string, n string, form int, output string"


def plain(d, t, percent=90, spm=20):
    """The contract for one document, with Python's own code points."""
    t = t or ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hexed = sha(f"1:{'' if d is None else d}")
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return (d, n, "plain", None, None, sha(t), sha(t))
    parts = ("<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]) if h4 % 100 < spm else ("<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b])
    return (d, n, "spm" if h4 % 100 < spm else "psm", a, b - a, sha(parts), sha(t))


def corpus():
    rng = random.Random(5)
    letters = "ab <>PSM\n\r\t\0é́ 漢\U0001f986&.\\'% "
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 127, 128, 129, 500]))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(700, None), (701, ""), (None, "no id at all"), (None, None), (-5, "negative"), (2**40, "big <S id"), (702, "a<P>b"), (703, "<P<S<M"), (704, "\U0001f986" * 70_000 + "z"), (705, "x" * 9_000_000)]
    return [*rows, rows[3], rows[3]]


def test_against_code_points(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "7", 1, "o") for d, t in rows], SCHEMA)
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted((tuple(r) for r in M.digests(M.fill_in_middle(df)).collect()), key=key)
    assert got == sorted((plain(d, t) for d, t in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_are_read_back(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, spm in ((100, 0), (100, 100), (0, 50)):
        formed = M.fill_in_middle(df, percent, spm)
        assert sorted((r["doc_id"] or -1, r["text"]) for r in M.restored(formed).collect()) == sorted((d or -1, t or "") for d, t in rows)
        forms = {r[0] for r in formed.select("form").distinct().collect()}
        assert forms == ({"plain"} if not percent else {"plain", "spm" if spm else "psm"})


def test_seed_moves_cuts_and_empty_table(spark):
    df = spark.createDataFrame([(i, "word " * 50) for i in range(40)], "doc_id long, text string")
    one, two = (sorted(tuple(r) for r in M.fill_in_middle(df, seed=s).select("doc_id", "output").collect()) for s in (1, 2))
    assert one != two
    assert M.digests(M.fill_in_middle(df.limit(0))).collect() == []
