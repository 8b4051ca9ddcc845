"""Block-compressed, indexed tables of regions: a sink, and a data source that opens only blocks which a region can touch.

Files are block gzip (independent blocks of 64 kB at most) with an index beside them in the widespread binned format: for
each sequence the chunks of the file that hold rows of each bin, bins of 16 kb up to 512 Mb, and the first chunk of each
16 kb. Filters on seqid, start and end reach the source, which looks them up in the index, and deals the chunks that are left
over tasks. Positions are 1-based, ends included.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the formats: the last block of a file, the positions that bins tell apart, the smallest bin's bits.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FARTHEST = 1 << 29
SMALLEST = 14

#: Compressed bytes that a task reads at least, where there are so many.
SPLIT = 8 << 20


def bins(begin: int, end: int) -> Iterator[int]:
    """All bins that may hold a row of 0-based [begin, end): eight times as many on each finer level."""
    first = 0
    for level in range(6):
        shift = SMALLEST + 3 * (5 - level)
        yield from range(first + (begin >> shift), first + ((end - 1) >> shift) + 1)
        first += 1 << 3 * level


def smallest_bin(begin: int, end: int) -> int:
    """The finest bin that holds all of 0-based [begin, end)."""
    for level in range(5, 0, -1):
        shift = SMALLEST + 3 * (5 - level)
        if begin >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


class Index(NamedTuple):
    """By sequence: chunks of each bin, and the first offset of each smallest bin; the columns, from 1, and the format."""

    bins: dict[str, dict[int, list[tuple[int, int]]]]
    first: dict[str, list[int]]
    columns: tuple[int, int, int]
    format: int
    comment: str
    skip: int

    def chunks(self, seqid: str, begin: int, end: int) -> list[tuple[int, int]]:
        """The parts of the file that may hold rows of 0-based [begin, end), by virtual offsets, none twice."""
        found, first = self.bins.get(seqid, {}), self.first.get(seqid, [])
        begin, end = max(0, begin), min(end, FARTHEST)
        if begin >= end or not found:
            return []
        least = first[min(begin >> SMALLEST, len(first) - 1)] if first else 0
        wanted = found.keys() if end - begin >= FARTHEST // 2 else [b for b in bins(begin, end) if b in found]
        return merged(c for b in wanted if b in found for c in found[b] if c[1] > least)


def merged(chunks: Iterator[tuple[int, int]] | list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order, those in one block joined, so that a block is opened once."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(chunks):
        if out and begin >> 16 <= out[-1][1] >> 16:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def parse_index(data: bytes) -> Index:
    """An index file's content."""
    data = gzip.decompress(data)
    magic, n, kind, seq, begin, end, comment, skip, length = struct.unpack_from("<4s8i", data)
    if magic != b"TBI\x01":
        raise ValueError("not an index of regions")
    at = 36
    names = data[at : at + length].rstrip(b"\0").split(b"\0") if length else []
    at += length

    def numbers(form: str) -> tuple[int, ...]:
        nonlocal at
        out = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return out

    by_bin, first = {}, {}
    for name in names[:n]:
        own: dict[int, list[tuple[int, int]]] = {}
        for _ in range(numbers("<i")[0]):
            b, m = numbers("<Ii")
            flat = numbers(f"<{2 * m}Q")
            if b <= smallest_bin(FARTHEST - 1, FARTHEST):  # what lies beyond are counts
                own[b] = list(zip(flat[::2], flat[1::2]))
        by_bin[name.decode()] = own
        first[name.decode()] = list(numbers(f"<{numbers('<i')[0]}Q"))
    return Index(by_bin, first, (seq, begin, end), kind, chr(comment) if comment else "", skip)


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def open_blocks(file, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from virtual offset `begin` up to and with that of `end`."""
    at = begin >> 16
    while at < end >> 16 or (at == end >> 16 and end & 0xFFFF):
        file.seek(at)
        head = file.read(12)
        if len(head) < 12:
            return
        extra = file.read(struct.unpack_from("<H", head, 10)[0])
        size, k = 0, 0
        while k < len(extra):
            if extra[k : k + 2] == b"BC":
                size = struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + struct.unpack_from("<H", extra, k + 2)[0]
        body = file.read(size - 12 - len(extra))
        yield at, zlib.decompress(body[:-8], wbits=-15)
        at += size


def chunk_lines(file, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin within the chunk."""
    rest = b""
    for at, block in open_blocks(file, begin, end):
        skip = begin & 0xFFFF if at == begin >> 16 else 0
        stop = end & 0xFFFF if at == end >> 16 else len(block)
        parts = (rest + block[skip:stop]).split(b"\n")
        rest = parts.pop()
        yield from parts
    if rest:
        yield rest


class Chunk(InputPartition):
    def __init__(self, path: str, index: Index, chunks: list[tuple[int, int]]) -> None:
        super().__init__((path, chunks))
        self.path, self.index, self.chunks = path, index._replace(bins={}, first={}), chunks


class RegionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        regions = options.get("regions")
        self.regions: list[tuple[str | None, int, int]] = [tuple(r) for r in json.loads(regions)] if regions else [(None, 1, FARTHEST)]
        self.names: set[str] | None = None
        self.low, self.high = 1, FARTHEST

    def pushFilters(self, filters: list) -> Iterator:
        """Narrow the names and the span in which rows may lie. Spark tests all filters once more on what is read."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "seqid" and isinstance(f, (EqualTo, In)):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = given if self.names is None else self.names & given
            elif name in ("start", "end") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = int(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, v - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Chunk]:
        system, path = _file_system(self.path)
        at = system.get_file_info(path)
        files = [path] if at.is_file else [x.path for x in system.get_file_info(pyarrow.fs.FileSelector(path)) if x.path.endswith(".gz")]
        out: list[Chunk] = []
        for file in sorted(files):
            with system.open_input_file(f"{file}.tbi") as f:
                index = parse_index(f.read())
            chunks: list[tuple[int, int]] = []
            for name, low, high in self.regions:
                for seqid in index.bins if name is None else [name]:
                    if self.names is None or seqid in self.names:
                        chunks += index.chunks(seqid, max(low, self.low) - 1, min(high, self.high))
            own: list[tuple[int, int]] = []
            for chunk in merged(chunks):
                own.append(chunk)
                if sum((e >> 16) - (b >> 16) for b, e in own) >= self.split:
                    out.append(Chunk(file, index, own))
                    own = []
            if own:
                out.append(Chunk(file, index, own))
        return out or [Chunk("", Index({}, {}, (1, 2, 2), 0, "", 0), [])]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.chunks:
            return
        system, _ = _file_system(self.path)
        seq, begin, end = partition.index.columns
        comment = partition.index.comment.encode()
        rows: list[tuple[str, int, int, list[str]]] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["seqid", "start", "end", "cells"])

        with system.open_input_file(partition.path) as file:
            for chunk in partition.chunks:
                for line in chunk_lines(file, *chunk):
                    if not line or (comment and line.startswith(comment)):
                        continue
                    cells = line.decode().rstrip("\r").split("\t")
                    start = int(cells[begin - 1]) + (partition.index.format >> 16 & 1)
                    if partition.index.format & 0xFFFF == 2:
                        last = start + len(cells[3]) - 1
                    else:
                        last = int(cells[end - 1]) if end else start
                    rows.append((cells[seq - 1], start, last, cells))
                    if len(rows) == 8192:
                        yield batch()
        if rows:
            yield batch()


class RegionSource(DataSource):
    """Rows of indexed files: seqid, start, end and all cells. Options: path (a file, or a folder of them), regions (a JSON
    list of [seqid, start, end]), split (compressed bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "indexed_regions"

    def schema(self) -> str:
        return "seqid string, start long, end long, cells array<string>"

    def reader(self, schema) -> RegionReader:
        return RegionReader(self.options)


def read_indexed(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """seqid, start, end, cells of the rows of an indexed file or a folder of them; with `regions`, of rows that touch any.

    The session's filter pushdown for Python sources is switched on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegionSource)
    reader = spark.read.format("indexed_regions").option("path", path)
    if regions is None:
        return reader.load()
    hit = F.lit(False)
    for seqid, low, high in regions:
        hit = hit | ((F.col("seqid") == seqid) & (F.col("start") <= high) & (F.col("end") >= low))
    return reader.option("regions", json.dumps([list(r) for r in regions])).load().filter(hit)


class _Writer:
    """One file's blocks and index."""

    def __init__(self, file, block: int) -> None:
        self.file, self.block, self.buffer, self.at = file, block, bytearray(), 0
        self.bins: dict[str, dict[int, list[list[int]]]] = {}
        self.first: dict[str, dict[int, int]] = {}

    def tell(self) -> int:
        return self.at << 16 | len(self.buffer)

    def flush(self) -> None:
        if self.buffer:
            packer = zlib.compressobj(wbits=-15)
            body = packer.compress(bytes(self.buffer)) + packer.flush()
            head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
            self.file.write(head + body + struct.pack("<II", zlib.crc32(self.buffer), len(self.buffer)))
            self.at += len(body) + 26
            self.buffer.clear()

    def add(self, seqid: str, start: int, end: int, line: bytes) -> None:
        if self.buffer and len(self.buffer) + len(line) + 1 > self.block:
            self.flush()
        begin = self.tell()
        for k in range(0, len(line) + 1, self.block):
            if k:
                self.flush()
            self.buffer += (line + b"\n")[k : k + self.block]
        chunks = self.bins.setdefault(seqid, {}).setdefault(smallest_bin(start - 1, end), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = self.tell()
        else:
            chunks.append([begin, self.tell()])
        first = self.first.setdefault(seqid, {})
        for k in range((start - 1) >> SMALLEST, ((end - 1) >> SMALLEST) + 1):
            first.setdefault(k, begin)

    def close(self) -> bytes:
        """The index, when the last block is written."""
        self.flush()
        self.file.write(END_BLOCK)
        names = b"".join(n.encode() + b"\0" for n in self.bins)
        out = [struct.pack("<4s8i", b"TBI\x01", len(self.bins), 0, 1, 2, 3, ord("#"), 0, len(names)), names]
        for seqid, own in self.bins.items():
            out.append(struct.pack("<i", len(own)))
            for b, chunks in own.items():
                out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", b, len(chunks), *[v for c in chunks for v in c]))
            first, last, filled = self.first[seqid], 0, []
            for k in range(max(first) + 1):
                last = first.get(k, last)
                filled.append(last)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        return gzip.compress(b"".join(out))


def write_indexed(df: DataFrame, path: str, seqid: str, start: str, end: str, files: int | None = None, block: int = 60_000) -> int:
    """Write rows, sorted, as block-compressed files with indexes into the folder `path`, a file for each range of places;
    seqid, start and end come first, then the other columns, as text. Returns the number of rows written.

    A file is written under the name of its range; a task that runs again replaces it. Rows without a place are left out.
    """
    others = [c for c in df.columns if c not in (seqid, start, end)]
    rows = df.filter(F.col(seqid).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    cells = [F.coalesce(F.translate(F.col(c).cast("string"), "\t\n\r", "   "), F.lit(".")) for c in (seqid, start, end, *others)]
    rows = rows.select(F.col(seqid).cast("string").alias("seqid"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.concat_ws("\t", *cells).alias("line"))
    dealt = (rows.repartitionByRange(files, "seqid", "start") if files else rows.repartitionByRange("seqid", "start")).sortWithinPartitions("seqid", "start", "end", "line")
    system, folder = _file_system(path)
    system.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = _file_system(path)
        name, n, writer, file = f"{folder}/part-{TaskContext.get().partitionId():05d}.gz", 0, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    file = system.open_output_stream(name, compression=None)
                    writer = _Writer(file, block)
                writer.add(*row[:3], row[3].encode())
                n += 1
        if writer:
            index = writer.close()
            file.close()
            with system.open_output_stream(f"{name}.tbi", compression=None) as out:
                out.write(index)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
