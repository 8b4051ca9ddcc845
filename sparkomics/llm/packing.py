"""Best-fit packing: documents become token pieces, pieces share sequences of a fixed capacity.

`tokenise` cuts every document into pieces of at most `capacity` tokens. `pack` deals the pieces over shards of a
bounded size by a hash, and packs each shard by bin completion: undominated fillings around the largest piece left are
the branches, the search goes back to the others where the waste exceeds what a better solution may have, and a best-fit
solution is the first incumbent. It ends when no branch is left, when the incumbent is as small as the sum of lengths
allows, or SEARCH_STEPS after its first descent in a shard; only in the last case may fewer sequences do. The emptiest
sequences of several shards are packed once more, together, so that shards cost no sequence each.

Nulls: a null text is the empty text (one piece, the end token alone); a null doc_id stays null. Repeated rows are
packed as often as they occur. Ties: pieces of one length are taken in the order of (doc_id, piece). Empty tables give
empty results. Further columns of the input are ignored.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 4096
END_ID = 1
#: Pieces in a shard, on average: what one task holds at once.
SHARD_PIECES = 20_000
#: Steps after which the fillings found for one sequence are tried, by waste, before more are sought.
SEARCH_NODES = 400
#: Steps of the search in one shard after its first descent; then the best solution so far is taken.
SEARCH_STEPS = 1_000_000

#: How the tokenizer's own pre-tokenizer splits a text without white space.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Characters that no normalisation changes and whose lower case is plain.
_SIMPLE = regex.compile(r"[!-~À-ɏ]*")
#: Byte-level vocabularies write the bytes without a printable letter of their own as the letters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Chunks and pre-tokens that a worker remembers.
_CHUNKS, _PARTS = 250_000, 350_000


class WordIds:
    """Token ids, as little-endian bytes, of whole texts: white-space chunks are encoded once and remembered.

    The tokenizer drops white space and never merges across it, nor across its pre-tokens, so that ids of chunks and of
    pre-tokens concatenate to the ids of the text. Chunks for which that could fail (special strings, characters that
    normalisation changes, separators that only Python calls white space) are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        """Ids of a lower-case pre-token, straight from the tokenizer's model, in the letters that it gives to bytes."""
        letters = part if part.isascii() else part.encode().decode("latin1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        packed = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if not _SIMPLE.fullmatch(low) or "<|" in chunk:
            return self._plain(chunk)
        if low.isalpha():
            parts = [low]
        elif low[:-1].isalpha() and low[-1] in ".,":
            parts = [low[:-1], low[-1]]
        else:
            parts = _PRE_TOKEN.findall(low)
        known = self.parts
        return b"".join([known.get(p) or self._part(p) for p in parts])

    def ids(self, text: str) -> bytes:
        if _SEPARATORS.search(text):
            return self._plain(text)
        words = text.split()
        known = self.chunks
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self._chunk(w)
            out = b"".join([known[w] for w in words])
        if len(known) > _CHUNKS:
            known.clear()
        if len(self.parts) > _PARTS:
            self.parts.clear()
        return out


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document, its end token included."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer_path), struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(text.as_py() or "") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing; lengths in descending order; the positions that each sequence holds."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a sequence has room for r
    for i, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def _dominated(chosen: list[int], left: int, free: int) -> bool:
    """Whether one free length could take the place of some chosen ones: of a smaller sum, or of several of its own sum."""
    one = several = 0  # bit s: a chosen length, or several of them, sum to s
    for n in chosen:
        several |= (several | one) << n
        one |= 1 << n
    larger, width = (one | several) << 1, 1  # in the end: sums greater by 1 to `left`
    while width < left:
        step = min(width, left - width)
        larger |= larger << step
        width += step
    return bool(free & (several | larger if left else several))


def _fillings(present: int, counts: list[int], room: int, nodes: int, budget: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(what is left of `room`, lengths in descending order) of every undominated filling, or as far as the budget goes.

    Fillings without waste come as they are found, others by waste after every `nodes` steps.
    """
    free, chosen, used, found = present, [], {}, []
    fitting = lambda room: free & ((1 << (room + 1)) - 1)
    frames = [(room, fitting(room))]  # room, and lengths still to be tried in it
    if not frames[0][1]:
        yield room, []
        return
    steps = 0
    while frames and budget[0] > 0:
        rest, fits = frames[-1]
        if not fits:
            frames.pop()
            if chosen:
                n = chosen.pop()
                used[n] -= 1
                free |= 1 << n
            continue
        n = fits.bit_length() - 1
        frames[-1] = rest, fits ^ (1 << n)
        steps += 1
        budget[0] -= 1
        left = rest - n
        chosen.append(n)
        used[n] = used.get(n, 0) + 1
        if used[n] == counts[n]:
            free ^= 1 << n
        frames.append((left, fitting(min(left, n))))
        if not fitting(left) and not _dominated(chosen, left, free):
            if left:
                found.append((left, chosen.copy()))
            else:
                yield 0, chosen.copy()
        if steps >= nodes:
            yield from sorted(found, key=lambda f: f[0])
            steps, found = 0, []
    yield from sorted(found, key=lambda f: f[0])


def bin_completion(lengths: np.ndarray, capacity: int, nodes: int = SEARCH_NODES, steps: int = SEARCH_STEPS) -> list[list[int]]:
    """Positions per sequence; lengths in descending order. Never worse than best fit, and the fewest sequences there can
    be if the search ends within `steps` after the first descent, which goes on until a sequence exceeds the waste bound."""
    incumbent = best_fit(lengths, capacity)
    total, most = int(lengths.sum()), len(incumbent)
    spare = (most - 1) * capacity - total  # the waste that a better solution may have
    if spare < 0:
        return incumbent
    stock: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stock.setdefault(int(lengths[i]), []).append(i)
    counts, present = [0] * (capacity + 1), 0
    for n, at in stock.items():
        counts[n] = len(at)
        present |= 1 << n

    def move(chosen: list[int], by: int) -> None:
        nonlocal present
        for n in chosen:
            counts[n] += by
            present = present | 1 << n if counts[n] else present & ~(1 << n)

    budget, waste, best = [sys.maxsize], 0, None
    levels: list[tuple[int, Iterator]] = []  # of each sequence: its largest length, and the fillings still to be tried
    path: list[tuple[int, list[int]]] = []  # and the one that is tried

    def begin() -> None:
        n = present.bit_length() - 1
        move([n], -1)
        levels.append((n, _fillings(present, counts, capacity - n, nodes, budget)))

    begin()
    while levels and spare >= 0:
        if len(path) == len(levels):
            left, chosen = path.pop()
            move(chosen, 1)
            waste -= left
        filling = next(levels[-1][1], None)
        if filling is None:
            if budget[0] <= 0:
                break
            move([levels.pop()[0]], 1)
            continue
        left, chosen = filling
        if waste + left > spare:
            budget[0] = min(budget[0], steps)
            continue  # waste bound: this branch can't beat the incumbent
        move(chosen, -1)
        waste += left
        path.append(filling)
        if present:
            begin()
        else:
            best = [[n, *c] for (n, _), (_, c) in zip(levels, path)]
            spare = (len(best) - 1) * capacity - total
            budget[0] = min(budget[0], steps)
    return incumbent if best is None else [[stock[m].pop() for m in b] for b in best]


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, level: int = 0) -> DataFrame:
    """The pieces with sequence_id and offset; `pieces` must be a stored table, since it is counted first."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        length = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        full = int((length == capacity).sum())
        sequence[:full] = np.arange(full)
        for b, at in enumerate(bin_completion(length[full:], capacity), full):
            at = np.array(at) + full
            sequence[at] = b
            offset[at] = np.cumsum(length[at]) - length[at]
        rest = sequence == np.bincount(sequence, weights=length).argmin()
        return pdf.assign(sequence_id=sequence + (pdf["shard"].to_numpy() << 32) + (level << 58), offset=offset, rest=rest).drop(columns="shard")

    dealt = pieces.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, piece, length, ids_crc32), {shards}L)"))
    packed = dealt.groupBy("shard").applyInPandas(one, columns + ", rest boolean")
    if shards == 1:
        return packed.drop("rest")
    packed = stored(packed, "packed")
    rest = stored(packed.filter("rest").drop("sequence_id", "offset", "rest"), "rest")
    return packed.filter("NOT rest").drop("rest").unionByName(pack(rest, capacity, shard_pieces, level + 1))


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its ids' checksum and its place: one row per piece."""
    return pack(stored(tokenise(docs, tokenizer_path, capacity), "pieces"), capacity)
