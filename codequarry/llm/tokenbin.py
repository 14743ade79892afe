"""Token-id files with Elias-Fano document boundaries.

Documents are range-partitioned by id (rows that repeat an id by a hash of their text too, so
that no id fills a task) and their ids concatenated, block by block. A block
holds the ids as one array (two bytes each where the vocabulary allows), and the documents'
end positions in Elias-Fano form: the low bits of each position packed, the high bits in
unary, with the place of every 256th one sampled. ``select(i)`` - the end of document i -
reads one sample and counts ones from there, so no 64-bit table of offsets is stored or
built. Document ids, which ascend too, are stored the same way. It takes about
2 + log2(mean document length) bits a document.

Blocks are kept as rows of a Parquet table (block number, bytes), so that any store that
Spark writes to will do, and a lost task is simply run again. A block starts with a header;
its global start is the sum of the ids of the blocks before it, from a small index.

Reading takes every document by ``select``: its two ends and its id.

Defined results: a null or empty text is the end id alone; rows that repeat an id stand in
the order of a hash of their texts; null ids come first; an empty table gives an empty file
set and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, partitions
from .tokens import FastTokenizer, public_path, tokenizer

MAGIC = b"CQTB0001"
#: A block ends with the document that reaches so many ids.
BLOCK_IDS = 500_000
SAMPLE = 256
_HEADER = struct.Struct("<8sQQQBBHI")  # magic, documents, ids, nulls, id bytes, reserved, reserved, crc of the ids


class EliasFano:
    """A non-decreasing sequence of numbers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self.places = memoryview(samples).cast("I") if samples else ()

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) + 1) if n else 0, np.uint8)
        bits[high] = 1
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        else:
            low = np.zeros(0, np.uint8)
        pack = lambda b: np.packbits(b, bitorder="little").tobytes()
        return EliasFano(n, low_bits, pack(low), pack(bits), high[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Value number i: the nearest sample, then ones counted word by word from there."""
        bit, left = self.places[i // SAMPLE], i % SAMPLE
        at = bit >> 3
        word = int.from_bytes(self.high[at : at + 8], "little") >> (bit & 7) << (bit & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            at += 8
            word = int.from_bytes(self.high[at : at + 8], "little")
        place, width = at * 8, 32
        while width:
            low = word & ((1 << width) - 1)
            if (ones := low.bit_count()) <= left:
                left -= ones
                word >>= width
                place += width
            else:
                word = low
            width >>= 1
        if not self.low_bits:
            return place - i
        first = i * self.low_bits
        rest = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7)
        return (place - i << self.low_bits) | rest & ((1 << self.low_bits) - 1)

    def to_bytes(self) -> bytes:
        parts = self.low, self.high, self.samples
        return struct.pack("<QBIII", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @staticmethod
    def from_bytes(raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, *sizes = struct.unpack_from("<QBIII", raw, at)
        at += struct.calcsize("<QBIII")
        parts = []
        for size in sizes:
            parts.append(bytes(raw[at : at + size]))
            at += size
        return EliasFano(n, low_bits, *parts), at


def encode_block(doc_ids: list[int | None], documents: list[bytes], width: int) -> bytes:
    """A block: header, document ids, end positions, ids. Documents: ids as 32-bit bytes,
    in ascending order of doc id, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(d) // 4 for d in documents], dtype=np.uint64)
    ids = np.frombuffer(b"".join(documents), "<u4").astype(f"<u{width}").tobytes()
    total = int(ends[-1]) if len(ends) else 0
    return b"".join(
        (
            _HEADER.pack(MAGIC, len(doc_ids), total, nulls, width, 0, 0, zlib.crc32(ids)),
            struct.pack("<q", base),
            EliasFano.build((known - base).astype(np.uint64)).to_bytes(),
            EliasFano.build(ends).to_bytes(),
            ids,
        )
    )


class Block:
    """A block read back: document i's ids by two selects, without any offset table."""

    def __init__(self, raw: bytes) -> None:
        view = memoryview(raw)
        magic, self.n, self.total, self.nulls, width, _, _, crc = _HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token block")
        (self.base,) = struct.unpack_from("<q", view, _HEADER.size)
        self.doc_ids, at = EliasFano.from_bytes(view, _HEADER.size + 8)
        self.ends, at = EliasFano.from_bytes(view, at)
        if zlib.crc32(view[at:]) != crc:
            raise ValueError("a token block is damaged")
        self.ids = np.frombuffer(view[at:], f"<u{width}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.doc_ids.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]

    def rows(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in the block, ids) of every document in turn, each by its selects."""
        for i in range(self.n):
            start, end = self.bounds(i)
            yield self.doc_id(i), start, self.ids[start:end]


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Blocks of all documents in ascending id order, as the Parquet table at ``folder``."""
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("ids", pa.int64()), ("block", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        with tokenizer(vocabulary) as tok:
            yield from blocks_of(batches, tok, TaskContext.get().partitionId())

    def blocks_of(batches: Iterator[pa.RecordBatch], tok: FastTokenizer, part: int) -> Iterator[pa.RecordBatch]:
        start = 0
        width = 2 if max(tok.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4

        def block(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal start
            ids = sum(len(r[1]) for r in rows) // 4
            raw = encode_block([r[0] for r in rows], [r[1] for r in rows], width)
            out = pa.RecordBatch.from_pylist([{"part": part, "start": start, "ids": ids, "block": raw}], schema)
            start += ids
            return out

        held, size = [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tok.each(batch.column(1).to_pylist()), strict=True):
                if size >= block_ids:
                    yield block(held)
                    held, size = [], 0
                held.append((doc_id, ids + end))
                size += len(held[-1][1]) // 4
        if held:
            yield block(held)

    # Rows equal in id and text, whose order doesn't matter, are told apart by their task.
    order = (F.col("_id").asc_nulls_first(), F.col("_hash"), F.col("_task"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
        .withColumns({"_hash": F.xxhash64("_text"), "_task": F.spark_partition_id()})
        .repartitionByRange(partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("_id", "_text")
    )
    # Ids are close to random bits: compressing them again would cost time and gain little.
    blocks = ordered.mapInArrow(encode, "part int, start long, ids long, block binary")
    blocks.write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: its id, start, n_tokens and the CRC of its ids."""
    blocks = spark.read.parquet(folder)
    # One total per write task; a block knows its start within the task's part.
    totals = {r["part"]: r["ids"] for r in blocks.groupBy("part").agg(F.sum("ids").alias("ids")).collect()}
    begin, at = {}, 0
    for part in sorted(totals):
        begin[part] = at
        at += totals[part]
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                first = start + begin[part]
                rows = [
                    (doc_id, first + place, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, place, ids in Block(raw.as_py()).rows()
                ]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return blocks.select("part", "start", "block").mapInArrow(
        decode, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the files (in the shared folder unless one is named) and read them back."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    write_token_files(docs, folder, vocabulary or public_path("word_bpe_49k.json"), end_id)
    return read_token_files(spark, folder)
