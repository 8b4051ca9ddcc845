import random
import re

import numpy as np
import pytest
from xxhash import xxh64

from sparkomics.llm import simhash as S


def plain_fingerprint(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxh64(b" ".join(r), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """fingerprint -> its component's smallest, over all pairs."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def result(rows):
    """The contract over (doc_id, text) rows."""
    fp = [plain_fingerprint(t) for _, t in rows]
    root, least = brute(sorted(set(fp))), {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return sorted(((d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(rows, fp)), key=str)


def corpus(seed, n=500):
    rng = random.Random(seed)
    words = [f"{c}{i}" for i in range(300) for c in "AbÉ"]
    base = [[rng.choice(words) for _ in range(rng.randrange(150, 400))] for _ in range(12)]
    rows = []
    for d in range(n):
        t = list(rng.choice(base[:2] if rng.random() < 0.5 else base)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randrange(0, 8))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((d * 7 % 1009 + 1, rng.choice([" ", "\t ", "\x0b"]).join(t)))
    return [*rows, (2000, None), (2001, ""), (2002, " \n\x0c"), (None, rows[0][1]), (None, "one two"), (None, "only here without an id"), rows[5], rows[5], (2003, " \x85 x"), (2004, "a b c " * 250_000)]


@pytest.mark.parametrize("how", [{}, {"tile": 3, "pool": 50}, {"blocks": 5, "tile": 8}, {"blocks": 6, "tile": 16, "pool": 4}])
def test_against_brute_force(spark, how):
    rows = corpus(len(how))
    df = spark.createDataFrame([(d, t, "a", 1, 2) for d, t in rows], "doc_id long, text string, fp string, node long, root int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df, **how).collect()), key=str)
    assert got == result(rows)
    assert 10 < len({r[2] for r in got}) < len({r[1] for r in got})


@pytest.mark.parametrize("tile", [8, 64, 512])
def test_dense_group_over_many_tiles(spark, tile):
    """Fingerprints around one centre, and chains that leave it, at exact distances of 3 and 4."""
    rng = random.Random(tile)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 900:
        f = centre
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])):
            f ^= 1 << b
        fps.add(f)
    far = rng.getrandbits(64)
    fps |= {far ^ ((1 << 3 * k) - 1) for k in range(12)} | {~far % 2**64, ~far % 2**64 ^ 0b1111}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = {r["node"]: r["component"] for r in S.links(df, tile=tile, pool=64).collect()}
    want = brute(sorted(fps))
    signed = {f: int(np.uint64(f).view(np.int64)) for f in fps}
    groups = lambda label: {frozenset(f for f in fps if label(f) == x) for x in {label(f) for f in fps}}
    assert groups(lambda f: found.get(signed[f], signed[f])) == groups(want.get)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base[rng.integers(0, 5, 40)] ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4))]))
    queries = fps[::3]
    want = {(i, j) for i, q in enumerate(queries) for j, f in enumerate(fps) if (int(q) ^ int(f)).bit_count() <= radius}
    assert set(zip(*map(np.ndarray.tolist, S.near_pairs(queries, fps, radius)))) == want
    assert [len(x) for x in S.near_pairs(queries[:0], fps, radius)] == [len(x) for x in S.near_pairs(fps, queries[:0], radius)] == [0, 0]


def test_long_texts_and_empty_table(spark):
    text = " ".join(f"w{i % 977}" for i in range(400_000)) + " " + "y" * 3_000_000
    assert len(text) > 2 * S.CHUNK and S.fingerprint(text.encode()) == plain_fingerprint(text)
    assert S.fingerprint(b"A  b") == plain_fingerprint("a b")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []


def test_one_of_each(spark):
    rows = [(3, "one two three four"), (1, "One two  three four"), (2, "quite different words stand here"), (None, "x"), (None, None)]
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, kept long")
    assert sorted(map(str, (r["doc_id"] for r in S.one_of_each(df).collect()))) == ["1", "2", "None", "None"]
