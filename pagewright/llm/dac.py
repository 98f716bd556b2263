"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, the lowest first. Level 0 holds the lowest chunk of every id and a
bitmap that says which ids go on; level 1 holds the next chunk of those alone, with a bitmap of its own,
and so on. A rank directory (ones before every 512 bits) gives an id's place on the next level, so any
id is found by a few look-ups, without decoding its neighbours.

Segment: magic; documents, ids and levels as decimals of 20 digits; document ids (little-endian i64), a byte
each that is 1 for a null document id, first ids of the documents (u64, one more than documents); then for
each level: length (u64), chunks (a byte each), bitmap (64-bit words), ranks (u64 for every 512 bits).
Each segment is a plain file of its own, written as it is by Spark's text writer (a line break ends it), which commits
files whole and on any file system; `_index` in the same folder says which ids are where. One id takes a few
ranged reads of at most 64 bytes (`TokenStore`).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, ordered, partitions
from .tokens import encoder

MAGIC = b"PWDAC002"
#: Ids of a segment: it ends with the document that reaches them.
SEGMENT = 4_000_000
_BLOCK, _HEAD = 512, 68


def encode(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A segment of documents; ids: little-endian unsigned 32-bit."""
    first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)]).astype("<u8")
    left = np.frombuffer(b"".join(ids), dtype="<u4")
    levels = []
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += bytes(-len(bits) % (_BLOCK // 8))
        ones = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint64) if bits else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if len(ones) else np.zeros(0, "<u8")
        levels.append(np.array([len(left)], dtype="<u8").tobytes() + (left & 0xFF).astype(np.uint8).tobytes() + bits + ranks.tobytes())
        left = left[more] >> 8
        if not len(left):
            break
    head = b"%020d%020d%020d" % (len(doc_ids), int(first[-1]), len(levels))
    keys = np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes()
    return MAGIC + head + keys + bytes(x is None for x in doc_ids) + first.tobytes() + b"".join(levels)


def _layout(read: Callable[[int, int], bytes]) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """Documents, ids and for each level (length, place of its chunks, of its bitmap, of its ranks); read(place, bytes)."""
    head = bytes(read(0, _HEAD))
    if head[:8] != MAGIC:
        raise ValueError("no segment of directly addressable codes")
    docs, n, levels = (int(head[8 + 20 * k : 28 + 20 * k]) for k in range(3))
    at, out = _HEAD + 9 * docs + 8 * (docs + 1), []
    for _ in range(levels):
        size = int.from_bytes(read(at, 8), "little")
        blocks = -(-size // _BLOCK)
        out.append((size, at + 8, at + 8 + size, at + 8 + size + blocks * _BLOCK // 8))
        at = out[-1][3] + 8 * blocks
    return docs, n, out


def read_id(read: Callable[[int, int], bytes], i: int) -> int:
    """Id i of a segment of which read(place, bytes) gives any part: a few reads of at most 64 bytes."""
    _, n, levels = _layout(read)
    if not 0 <= i < n:
        raise IndexError(i)
    value = 0
    for k, (_, chunks, bits, ranks) in enumerate(levels):
        value |= read(chunks + i, 1)[0] << 8 * k
        start = i // _BLOCK * _BLOCK
        part = np.unpackbits(np.frombuffer(read(bits + start // 8, i // 8 - start // 8 + 1), np.uint8), bitorder="little")
        if not part[i - start]:
            break
        i = int.from_bytes(read(ranks + 8 * (i // _BLOCK), 8), "little") + int(part[: i - start].sum())
    return value


class Segment:
    """Reads a segment: doc_ids, first (first id of each document), segment[i], segment.slice(a, b)."""

    def __init__(self, data: bytes):
        docs, self.n, levels = _layout(lambda at, n: data[at : at + n])
        keys, nulls = np.frombuffer(data, "<i8", docs, _HEAD), np.frombuffer(data, np.uint8, docs, _HEAD + 8 * docs)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, nulls, strict=True)]
        self.first = np.frombuffer(data, "<u8", docs + 1, _HEAD + 9 * docs).astype(np.int64)
        self.levels = []
        for n, chunks, bits, ranks in levels:
            blocks = -(-n // _BLOCK)
            self.levels.append((np.frombuffer(data, np.uint8, n, chunks), np.frombuffer(data, np.uint8, blocks * _BLOCK // 8, bits), np.frombuffer(data, "<u8", blocks, ranks).astype(np.int64)))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bits, ranks = self.levels[level]
        if i >= len(bits) * 8:
            return int(ranks[-1]) + int(np.unpackbits(bits[-_BLOCK // 8 :]).sum()) if len(ranks) else 0
        start = i // _BLOCK * _BLOCK
        part = np.unpackbits(bits[start // 8 : i // 8 + 1], bitorder="little")
        return int(ranks[i // _BLOCK]) + int(part[: i - start].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (without b), as unsigned 32-bit integers; reads only their places on each level."""
        out = np.zeros(max(0, b - a), dtype="<u4")
        where = np.arange(len(out))
        for k, (chunks, bits, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[a:b].astype("<u4") << (8 * k)
            go = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            where = where[go]
            a = self._rank(k, a) if k + 1 < len(self.levels) else 0
            b = a + len(where)
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, separator: str = "\n") -> None:
    """Writes segments to files of a folder, documents in ascending order of key, and their index (path, part, segment,
    n_docs, n_tokens, start) to its `_index`; (part, segment), from the file's name, orders the segments.

    Null text is empty: end_id alone. Null keys come last; rows of one key go by a hash of their text, full
    repeats are written as often as they occur. An empty table writes no segment.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, separator)
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal keys, ids, size
            out = pa.RecordBatch.from_arrays([pa.array([encode(keys, ids)], pa.binary())], ["payload"])
            keys, ids, size = [], [], 0
            return out

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1)), strict=True):
                keys.append(k)
                ids.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= SEGMENT:
                    yield row()
        if keys:
            yield row()

    k, t = F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")
    order = [F.col("key").asc_nulls_last(), F.xxhash64("text")]
    spark = docs.sparkSession
    bounded_batches(spark)
    dealt = docs.select(k, t).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    payloads = dealt.mapInArrow(run, "payload binary").select(F.col("payload").cast("string").alias("value"))
    payloads.write.options(maxRecordsPerFile=1, compression="none").text(path)
    digits = lambda k: F.substring(F.col("content"), 9 + 20 * k, 20).cast("string").cast("long")
    found = _files(spark, path).select("path", "part", "segment", digits(0).alias("n_docs"), digits(1).alias("n_tokens"))
    starts = ordered(found, ["part", "segment"], {"start": "n_tokens"})
    starts.select("path", "part", "segment", "n_docs", "n_tokens", "start").write.parquet(f"{path}/_index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, segment, content): Spark names files by task, a random id (which may have "-c" and digits, too) and
    their number in the task, which the file's ending follows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("int")
    return files.select("path", number("/part-([0-9]+)-[^/]*$").alias("part"), number(r"-c([0-9]+)\.[^/]*$").alias("segment"), "content")


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """From the files: (doc_id, start, n_tokens, ids_crc32[, ids]) for each document, start over all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Segment(batch.column(2)[i].as_buffer())
                whole = s.slice(0, len(s)).tobytes()
                cut = [(int(a), int(b)) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
                pieces = [whole[4 * a : 4 * b] for a, b in cut]
                cols = [
                    pa.array(s.doc_ids, pa.int64()), *(pa.array([batch.column(c)[i].as_py()] * len(cut), pa.int32()) for c in (0, 1)),
                    pa.array([a for a, _ in cut], pa.int64()), pa.array([b - a for a, b in cut], pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                ]
                names = ["doc_id", "part", "segment", "at", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.array(pieces, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    files = _files(spark, path).select("part", "segment", "content")
    docs = files.mapInArrow(run, "doc_id long, part int, segment int, at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    starts = spark.read.parquet(f"{path}/_index").select("part", "segment", F.col("start").alias("before"))
    at = docs.join(starts, ["part", "segment"])
    return at.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


class TokenStore:
    """store[i]: id i of all files of a folder, by ranged reads on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.index = spark, spark.read.parquet(f"{path}/_index")

    def __getitem__(self, i: int) -> int:
        row = self.index.where((F.col("start") <= i) & (F.col("start") + F.col("n_tokens") > i)).first()
        if row is None:
            raise IndexError(i)
        jvm = self.spark.sparkContext._jvm
        file = jvm.org.apache.hadoop.fs.Path(row["path"])
        stream = file.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(file)

        def read(at: int, n: int) -> bytes:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

        try:
            return read_id(read, i - row["start"])
        finally:
            stream.close()
