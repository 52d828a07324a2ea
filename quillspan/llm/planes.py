"""Token-id files of byte or bit planes.

A file is a row of frames, each closed by a line feed. A block frame holds up to BLOCK_IDS ids,
transposed into planes (the first bytes of all ids, then the second, or the same by bits), each plane
compressed by zstandard. The last frame is the index: each block's place, length and first id's number,
and each document's key and length; a fixed trailer says where it starts. Spark's text writer puts the
frames down as they are, so files go to any store that Spark writes to, by its commit protocol, and a
lost task leaves none.

Layout, little-endian: block frame `QPB1`, u8 planes, u8 kind (1 byte, 0 bit), u32 ids, u32 x planes
compressed lengths, then the planes. Index frame `QPX1`, u32 blocks, u32 documents, u32 compressed
length, then zstandard of (u64 place, u32 ids, u64 first) by block and (i64 key, u64 length) by
document; trailer u64 place of the index frame, `QPE1`.

Null and empty texts hold the end id alone; equal rows are written each; rows with a null key stand
first, under the smallest 64-bit number; an empty table gives no block and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, blocks, by_frames, framed, fresh_path, remove, saved
from .tokens import TOKENIZER, encoder, tokenizer_path

BLOCK_IDS = 1 << 16
#: Bytes of text that one file is to hold.
FILE_TEXT = 24_000_000
NO_KEY = -(2**63)


def pack_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """A block frame."""
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()) if len(ids) else 0
    if bits:
        n = max(1, top.bit_length())
        planes = [np.packbits(((ids >> np.uint32(k)) & 1).astype(np.uint8)) for k in range(n)]
    else:
        n = max(1, -(-top.bit_length() // 8))
        planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T)[:n]
    squeeze = zstandard.ZstdCompressor(level=level).compress
    parts = [squeeze(p.tobytes()) for p in planes]
    return struct.pack(f"<4sBBI{n}I", b"QPB1", n, 0 if bits else 1, len(ids), *map(len, parts)) + b"".join(parts)


def unpack_planes(data: bytes, at: int = 0) -> np.ndarray:
    """The ids of the block frame at a place."""
    import zstandard

    magic, n, whole, count = struct.unpack_from("<4sBBI", data, at)
    if magic != b"QPB1":
        raise ValueError("no block frame here")
    sizes = struct.unpack_from(f"<{n}I", data, at + 10)
    at += 10 + 4 * n
    ids = np.zeros(count, "<u4")
    spread = zstandard.ZstdDecompressor().decompress
    view = ids.view(np.uint8).reshape(-1, 4)
    for k, size in enumerate(sizes):
        plane = np.frombuffer(spread(data[at : at + size], max_output_size=count or 1), np.uint8)
        at += size
        if whole:
            view[:, k] = plane
        else:
            ids |= np.unpackbits(plane, count=count).astype("<u4") << np.uint32(k)
    return ids


class FileMaker:
    """Frames of one file, in turn; keeps a block's ids and the index, nothing else."""

    def __init__(self, bits: bool = False, block_ids: int = BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        self.waiting: list[np.ndarray] = []
        self.held = self.place = self.first = 0
        self.index: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []

    def _block(self, ids: np.ndarray) -> bytes:
        frame = pack_planes(ids, self.bits)
        self.index.append((self.place, len(ids), self.first))
        self.place += len(frame) + 1
        self.first += len(ids)
        return frame

    def add(self, key: int, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append((key, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                yield self._block(flat[at : at + self.block_ids])
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def close(self) -> Iterator[bytes]:
        import zstandard

        if not self.docs:
            return
        if self.held:
            yield self._block(np.concatenate(self.waiting))
        table = np.array(self.index, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes()
        packed = zstandard.ZstdCompressor(level=3).compress(table)
        yield struct.pack("<4sIII", b"QPX1", len(self.index), len(self.docs), len(packed)) + packed + struct.pack("<Q4s", self.place, b"QPE1")


def read_index(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, ids, first) by block and (key, length) by document of a file."""
    import zstandard

    end = len(data) - 1  # the last line feed
    place, magic = struct.unpack_from("<Q4s", data, end - 12)
    if magic != b"QPE1":
        raise ValueError("the file has no trailer")
    magic, n, docs, size = struct.unpack_from("<4sIII", data, place)
    table = zstandard.ZstdDecompressor().decompress(data[place + 16 : place + 16 + size], max_output_size=24 * n + 16 * docs)
    return np.frombuffer(table, "<u8", 3 * n).reshape(-1, 3).astype(np.int64), np.frombuffer(table, "<i8", 2 * docs, 24 * n).reshape(-1, 2)


def read_documents(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, number of ids before it in the file, ids) of each document; one block at a time is open."""
    index, docs = read_index(data)
    queue, held, block, start = [], 0, 0, 0
    for key, length in docs.tolist():
        while held < length:
            ids = unpack_planes(data, int(index[block, 0]))
            queue.append(ids)
            held += len(ids)
            block += 1
        flat = queue[0] if len(queue) == 1 else np.concatenate(queue) if queue else np.zeros(0, "<u4")
        yield key, start, flat[:length]
        queue, held, start = [flat[length:]], held - length, start + length


def write_ids(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 0, bits: bool = False) -> None:
    """Write the ids of all documents, in ascending key order over the files' numbers."""
    file = tokenizer_path(tokenizer)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, maker = encoder(file).encode, FileMaker(bits)
        for block in blocks(batches):
            out: list[bytes] = []
            for key_, ids in zip(block["key"].fillna(NO_KEY).tolist(), encode(block["text"].tolist()), strict=True):
                out += maker.add(int(key_), np.append(ids, end_id).astype("<u4"))
            yield pd.DataFrame({"frame": out})
        yield pd.DataFrame({"frame": list(maker.close())})

    salt = F.xxhash64("text")  # so that a key with very many rows is divided too
    dealt = rows.repartitionByRange(max(1, -(-total // FILE_TEXT)), F.col("key"), salt).sortWithinPartitions(F.col("key"), salt)
    by_frames(dealt, frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of each document, read from the files at a path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, data in zip(batch["file"], batch["content"], strict=True):
                rows = [(number, key, start, len(ids), zlib.crc32(ids.tobytes())) for key, start, ids in read_documents(data)]
                yield framed(rows, ["file", "key", "start", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = found.where("length > 0").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")
    with arrow_rows(spark, 1):  # a row is a file
        rows = saved(files.mapInPandas(read, "file int, key long, start long, n_tokens long, ids_crc32 long"))
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))  # a row for each file
    return rows.join(ahead, "file").select(F.when(F.col("key") != NO_KEY, F.col("key")).alias("key"), (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def ids_through_files(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 0, bits: bool = False) -> DataFrame:
    """Write, then read back: key, start, n_tokens, ids_crc32."""
    path = fresh_path(df.sparkSession, "planes")
    write_ids(df, path, key, text, tokenizer, end_id, bits)
    rows = read_ids(df.sparkSession, path).withColumnRenamed("key", key)  # read once, and kept
    remove(df.sparkSession, path)
    return rows
