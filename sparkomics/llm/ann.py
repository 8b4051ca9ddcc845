"""Approximate nearest neighbours by cross-polytope hashing.

Each of `tables` hash tables turns unit vectors by three rounds of random signs and a fast Hadamard transform and puts
them into the bucket of their nearest signed axis. A query probes the `probes` nearest axes of each table, and collects
the rows of these buckets; rows found in `votes` tables or more are its candidates, ranked by their exact cosine in
double precision. Where fewer than k rows of the whole table are found so often, those found most often fill up.

Every row is indexed. The queries are a stated set: they go to the tasks in blocks of at most `block` rows. Each task
indexes its own rows by table and bucket, a stretch at a time; the candidates of a query don't depend on how rows are
dealt to tasks, and only its best k of each task leave it.

Nulls: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id.
Vectors are compared only with those of as many components. Rows with the query's own vec_id are no candidates of it.
Ties go to the smaller vec_id; of repeated rows each counts. A table of few rows gives all of them. Empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

TABLES, PROBES, VOTES, SEED = 32, 8, 4, 20_240_601
QUERY_BLOCK = 4096
_ROWS = 8192  # that are indexed at once


def vectors(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the ids and the vectors of rows that take part."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten()
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    value = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    known = ~ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero((length == d) & known)
        x = value[start[rows][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(axis=1)
        ok[ok] = (x[ok] != 0).any(axis=1)
        if ok.any():
            out[int(d)] = ids[rows[ok]], np.ascontiguousarray(x[ok])
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, tables: int, seed: int) -> Iterator[np.ndarray]:
    """The pseudo-random rotation of x for each table."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng([seed, d])
    for _ in range(tables):
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], d))
        yield y


def buckets(x: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """(tables, rows): twice the nearest axis, and one more on its positive side."""
    rows = np.arange(len(x))
    out = np.empty((tables, len(x)), dtype=np.int32)
    for t, y in enumerate(rotations(x, tables, seed)):
        axis = np.abs(y).argmax(axis=1)
        out[t] = 2 * axis + (y[rows, axis] > 0)
    return out


def probed(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(tables, queries, probes): the buckets that a query probes, nearest first."""
    out = []
    for y in rotations(x, tables, seed):
        side = np.empty((len(x), 2 * y.shape[1]))
        side[:, 0::2], side[:, 1::2] = -y, y
        out.append(np.argsort(-side, axis=1, kind="stable")[:, :probes])
    return np.stack(out)


class Index:
    """Rows by table and bucket: those of bucket b of table t are rows[at[t, b]:at[t, b + 1]]."""

    def __init__(self, x: np.ndarray, tables: int, seed: int) -> None:
        found = buckets(x, tables, seed)
        self.n, width = len(x), 2 << max(0, x.shape[1] - 1).bit_length()
        order = np.argsort(found, axis=1, kind="stable")
        self.rows = order.ravel()
        counts = np.stack([np.bincount(b, minlength=width) for b in found])
        self.at = np.concatenate([np.zeros((tables, 1), np.int64), np.cumsum(counts, axis=1)], axis=1) + self.n * np.arange(tables)[:, None]

    def shares(self, probes: np.ndarray) -> np.ndarray:
        """In how many tables each row is in one of the buckets (tables, probes)."""
        tables = np.arange(len(probes))[:, None]
        start, end = self.at[tables, probes].ravel(), self.at[tables, probes + 1].ravel()
        n = end - start
        index = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.rows[index], minlength=self.n)


def best(ids: np.ndarray, scores: np.ndarray, shares: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: by shares, then score, ties by id."""
    if len(ids) > 4 * k:
        most = np.flatnonzero(shares >= np.partition(shares, -k)[-k])
        at = most[scores[most] >= np.partition(scores[most], -k)[-k]] if shares[most].min() == shares.max() else most
        return at[np.lexsort((ids[at], -scores[at], -shares[at]))][:k]
    return np.lexsort((ids, -scores, -shares))[:k]


def search(base: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES, votes: int = VOTES, seed: int = SEED, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of `queries` its k nearest rows of `base` that are found.

    Both hold vec_id and embedding.
    """
    spark = base.sparkSession
    rows = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    base, queries = base.select(*rows), queries.select(*rows)
    n_blocks = max(1, -(-queries.count() // block))
    schema = "query long, query_id long, vec_id long, score double, shares int"
    parts = []
    for b in range(n_blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow().combine_chunks()
        found = vectors(part["vec_id"].combine_chunks(), part["embedding"].combine_chunks()) if len(part) else {}
        sent, number = {}, 0
        for d, (ids, x) in found.items():
            unit = norms(x)
            sent[d] = (np.arange(number, number + len(ids)), ids, x, unit, probed(x / unit[:, None], tables, probes, seed))
            number += len(ids)
        shared = spark.sparkContext.broadcast(sent)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # By query: its id, and ids, scores and shares of the best rows so far; candidates have `votes` as their shares.
            top: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for d, (ids, x) in vectors(batch.column(0), batch.column(1)).items():
                    for at in range(0, len(ids) if d in shared.value else 0, _ROWS):
                        compare(ids[at : at + _ROWS], x[at : at + _ROWS], shared.value[d], top)
            out = [(q, own, *row) for q, (own, *found) in top.items() for row in zip(*(c.tolist() for c in found))]
            columns = list(zip(*out)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query", "query_id", "vec_id", "score", "shares"])

        def compare(ids: np.ndarray, x: np.ndarray, sent: tuple, top: dict) -> None:
            numbers, own_ids, queries, query_norms, probes_of = sent
            size = norms(x)
            index = Index(x / size[:, None], tables, seed)
            for q, own in enumerate(own_ids):
                shares = np.minimum(index.shares(probes_of[:, q]), votes)
                shares[ids == own] = -1
                at = np.flatnonzero(shares == votes)
                held = top.get(numbers[q], (own, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                if len(at) < k and (held[3] == votes).sum() < k:
                    at = np.flatnonzero(shares >= 0)
                if len(at):
                    scores = (x[at] * queries[q]).sum(axis=1) / (size[at] * query_norms[q])
                    found = [np.concatenate(c) for c in zip(held[1:], (ids[at], scores, shares[at]))]
                    keep = best(*found, k)
                    top[numbers[q]] = own, *(c[keep] for c in found)

        result = base.mapInArrow(run, schema)
        parts.append((stored(result, "neighbours") if n_blocks > 1 else result).withColumn("block", F.lit(b)))
    merged = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("block", "query").orderBy(F.desc("shares"), F.desc("score"), "vec_id")
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    kept = merged.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
