"""SimHash near-dedup: fingerprints of word shingles, linked at a small Hamming distance by bit-sliced comparison.

A fingerprint has 64 bits. Of a text's words (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case) all runs of SHINGLE words, repeats
included, are hashed by XXH64 with SEED, joined by spaces (fewer words: all as one run); a bit is 1 if it is set in over half
of the hashes. A text without words has the fingerprint zero, which is linked like any other.

Documents with one fingerprint are a class, and only classes are compared. Two fingerprints within the radius agree on
`blocks - radius` of any `blocks` blocks of their bits; so each choice of so many blocks is a table, and fingerprints meet
where a table deals them to one pool by a hash of those bits. Within a pool all are compared, bit-sliced: bit planes are
stored vertically, 64 fingerprints to a word, two planes at a time go into carry-save counters of whole words, and words
in which all 64 have exceeded the radius are abandoned; work goes on with the others.

Pools that one key fills beyond TILE are dealt into tiles. A first round compares within tiles. With the components
that it gives, a second one compares only what isn't in the pool's largest component, in chunks of TILE, with all tiles. So
a task holds two tiles at most, no link between components is lost, and no pairs are made within a component. A pool gives
one edge for each of its fingerprints at most.

More tables with longer keys (`blocks`) only move work: all give the same links. `layout` takes 4 blocks up to 2^27
fingerprints, 5 up to 2^38, then 6.

Nulls: a null text counts as empty. Rows without doc_id have a fingerprint and link others, and are never a component's
smallest; component_id is null where a component has no doc_id. Rows that share a doc_id are documents of their own.
Ties: none, components don't depend on order. Very long texts are hashed in runs of CHUNK bytes. An empty table gives no
rows. Extra columns don't matter, whatever their names: only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, stored
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
TILE = 512
POOL = 256
CHUNK = 1 << 20

_LOWER = LOWER.tobytes()
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words in lists of about CHUNK bytes, each beginning with the last SHINGLE - 1 words of the list before it."""
    at, last = 0, []
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        words = last + text[at:end].translate(_LOWER).split()
        yield words
        at, last = end, words[-(SHINGLE - 1) :]


def _votes(hashes: list[int]) -> np.ndarray:
    """How many hashes have each bit, lowest first."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits, axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    from xxhash import xxh64_intdigest as xxh64

    total, votes, words = 0, np.zeros(BITS, dtype=np.int64), []
    for words in _word_runs(text):
        if hashes := [xxh64(b" ".join(run), SEED) for run in zip(*(words[k:] for k in range(SHINGLE)))]:
            total, votes = total + len(hashes), votes + _votes(hashes)
    if not total:
        if not words:
            return 0
        total, votes = 1, _votes([xxh64(b" ".join(words), SEED)])
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: each row's fingerprint as a long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row b has bit b of 64 of them in each word; the last word is filled up with zeros."""
    bits = np.zeros((-(-len(fps) // 64) * 64, BITS), dtype=np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def near_pairs(queries: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (in queries, in fps) of all pairs at a distance of `radius` or less.

    A cell is a query and a word of 64 fingerprints. Its counters begin at 2^k - 1 - radius, so that the carry out of the
    highest tells that a distance exceeds the radius; it stays in `over`.
    """
    if not len(queries) or not len(fps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    down = planes(fps)
    words = down.shape[1]
    masks = np.where((queries[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1), _ONES, np.uint64(0))
    q, w = np.repeat(np.arange(len(queries)), words), np.tile(np.arange(words), len(queries))
    k = max(1, radius.bit_length())
    counters = [np.full(len(q), _ONES if (2**k - 1 - radius) >> i & 1 else np.uint64(0), dtype=np.uint64) for i in range(k)]
    filled = np.zeros(words, dtype=np.uint64)
    if len(fps) % 64:
        filled[-1] = _ONES << np.uint64(len(fps) % 64)
    over = filled[w]
    for b in range(0, BITS, 2):
        x, y = down[b][w] ^ masks[q, b], down[b + 1][w] ^ masks[q, b + 1]
        odd = x ^ y
        carry = (x & y) | (counters[0] & odd)
        counters[0] = counters[0] ^ odd
        for i in range(1, k):
            carry, counters[i] = counters[i] & carry, counters[i] ^ carry
        over |= carry
        if b >= 12 and b % 4 == 0:
            left = np.flatnonzero(over != _ONES)
            if 3 * len(left) < 2 * len(q):
                q, w, over, counters = q[left], w[left], over[left], [c[left] for c in counters]
            if not len(left):
                break
    cell, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[cell], w[cell] * 64 + lane


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest that links (a, b) reach."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        for at in (a, b, least[a], least[b]):
            np.minimum.at(now, at, low)
        while (further := now[now] < now).any():
            now[further] = now[now][further]
        if (now == least).all():
            return least
        least = now


def pool_edges(queries: np.ndarray, fps: np.ndarray, radius: int) -> pa.Table:
    """a, b: edges that connect what links between queries and fps connect, one for each fingerprint at most."""
    every = np.unique(np.concatenate([queries, fps]))
    a, b = near_pairs(queries, fps, radius)
    least = least_linked(len(every), np.searchsorted(every, queries)[a], np.searchsorted(every, fps)[b])
    joined = np.flatnonzero(least != np.arange(len(every)))
    return pa.table({"a": pa.array(every[joined].view(np.int64)), "b": pa.array(every[least[joined]].view(np.int64))})


def _fps(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def layout(n: int, radius: int = RADIUS) -> int:
    """Blocks of bits for n fingerprints."""
    return radius + (1 if n <= 1 << 27 else 2 if n <= 1 << 38 else 3)


def keyed(classes: DataFrame, n: int, radius: int, blocks: int, pool: int) -> DataFrame:
    """fp, table, pool: each fingerprint in its pool of each table. Pools hold about `pool` fingerprints where keys are even."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in agreed) for agreed in combinations(range(blocks), blocks - radius)]
    pools = 1 << max(0, ceil(log2(max(1, n) / pool)))
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    dealt = [F.struct(F.lit(k).alias("table"), F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed(m)))), F.lit(pools)).alias("pool")) for k, m in enumerate(masks)]
    return classes.select("fp", F.inline(F.array(*dealt)))


def links(classes: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE, pool: int = POOL) -> DataFrame:
    """node, component of those fingerprints (`fp`, distinct) that have a link."""
    n = classes.count()
    every = keyed(classes, n, radius, blocks or layout(n, radius), pool)
    large = stored(every.groupBy("table", "pool").agg(F.ceil(F.count("*") / tile).alias("tiles")).filter("tiles > 1"), "large-pools")
    placed = every.join(large, ["table", "pool"], "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64("fp", "table"), "tiles"), F.lit(0)))

    def within(group: pa.Table) -> pa.Table:
        fps = _fps(group["fp"])
        return pool_edges(fps, fps, radius)

    def between(group: pa.Table) -> pa.Table:
        fps, asks = _fps(group["fp"]), np.asarray(group["asks"])
        return pool_edges(fps[asks], fps[~asks], radius)

    found = components(placed.select("table", "pool", "tile", "fp").groupBy("table", "pool", "tile").applyInArrow(within, "a long, b long"))
    if large.isEmpty():
        return found
    found = stored(found, "tile-links")
    at = ["table", "pool"]
    hot = placed.filter("tiles IS NOT NULL").join(found, F.col("fp") == F.col("node"), "left").select(*at, "tile", "tiles", "fp", F.coalesce("component", "fp").alias("part"))
    hot = stored(hot, "large-pool-rows")
    parts = hot.groupBy(*at, "part").agg(F.count("*").alias("n"))
    main = parts.groupBy(*at).agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / tile).alias("chunks")).filter("chunks > 0")
    hot = hot.join(main, at)
    asking = hot.filter("part != main").select(*at, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("table", "fp"), "chunks").alias("chunk"), "fp", F.lit(True).alias("asks"))
    asked = hot.select(*at, "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "fp", F.lit(False).alias("asks"))
    more = asking.unionByName(asked).groupBy(*at, "tile", "chunk").applyInArrow(between, "a long, b long")
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, itself included)."""
    rows = stored(fingerprints(docs), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    found = links(classes.select("fp"), radius, **how)
    roots = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = roots.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Those rows of docs that have the smallest doc_id of their component, and rows without doc_id."""
    kept = near_duplicates(docs, **how).filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["kept"], "left_semi").unionByName(docs.filter(docs["doc_id"].isNull()))
