"""Best-fit packing with certified bin counts.

Documents become token ids (each ended by ``end_id``); longer ones than a sequence are cut
into full pieces, of which the first may be shorter. Pieces are dealt into partitions of
bounded size; each partition runs best-fit decreasing and computes a lower bound on its bin
count from dual-feasible functions. A partition whose count equals its bound is certified.
The pieces in partly filled bins of the others - and, of every partition, the piece-poorest
bin, whose space a partition's own bound can't judge - are exchanged: pooled, dealt into
fewer partitions and packed again, until no partition has a gap, an exchange gains nothing,
all pieces of a turn fit one partition, or ``max_turns`` (12) turns are done.

Only (id, piece, length) rows move after tokenising, never ids or text. An exchange that
doesn't lower the count is thrown away, so counts never rise.

Defined results: a null or empty text is the end id alone; rows with equal or null ids are
packed one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import public_path, tokenizer

CAPACITY = 2048
#: Pieces that one task packs at a time.
PARTITION_PIECES = 40_000

PACKED = "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, _gap boolean"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but perhaps the first."""
    head = (total - 1) % capacity + 1
    return [(0, head)] + [(s, capacity) for s in range(head, total, capacity)]


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
) -> DataFrame:
    """Per piece: _id, piece, start, length, ids_crc32."""
    end = int(end_id).to_bytes(4, "little")

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,crc:long>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with tokenizer(vocabulary) as tok:
            for texts in batches:
                rows = []
                for own in tok.each(texts.tolist()):
                    ids = own + end
                    rows.append(
                        [
                            {"piece": k, "start": s, "length": n, "crc": zlib.crc32(ids[4 * s : 4 * (s + n)])}
                            for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))
                        ]
                    )
                yield pd.Series(rows)

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.explode(pieces(F.col(text_col))).alias("p")).select(
        "_id", "p.piece", "p.start", "p.length", F.col("p.crc").alias("ids_crc32")
    )


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual-feasible functions' bounds on the number of bins."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * sizes).sum()) // capacity)
    # f_e: sizes over capacity - e count as full bins, sizes under e as nothing.
    number, volume = np.cumsum(count), np.cumsum(count * sizes)
    for e in np.flatnonzero(count[: capacity // 2 + 1]):
        e = int(e)
        if e:
            full = int(number[-1] - number[capacity - e])
            middle = int(volume[capacity - e] - volume[e - 1])
            best = max(best, full + -(-middle // capacity))
    # u_k: sizes rounded down to parts of k, but whole multiples of 1/(k+1) kept.
    used = np.flatnonzero(count)
    for k in range(1, 33):
        scaled = (k + 1) * used
        exact = scaled % capacity == 0
        # In units of 1/(k (k+1)) of a bin.
        value = np.where(exact, k * scaled // capacity, (k + 1) * (scaled // capacity))
        best = max(best, -(-int((value * count[used]).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the bins' fills."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some open bin has exactly r left
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            own, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = own, fill[own]
        fill[own] += size
        if left := room - size:
            by_room[left].append(own)
            rooms |= 1 << left
    return bins, offsets, fill


def _packed(pieces: DataFrame, partitions: int, turn: int, capacity: int) -> DataFrame:
    """One round: every partition packed and judged."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        table = table.drop_columns(["_part"]).sort_by(order)
        lengths = table["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        fills = np.asarray(fill, np.int64)[bins]
        gap = len(fill) > lower_bound(lengths, capacity)
        poorest = int(np.argmin(fill))
        made = {
            "sequence_id": (np.int64(turn) << 56) + (np.int64(key[0].as_py()) << 24) + bins,
            "offset": offsets,
            "_gap": (fills < capacity) & (gap | (bins == poorest)),
        }
        for name, values in made.items():
            table = table.append_column(name, pa.array(values))
        return table

    dealt = pieces.select(
        "_id", "piece", "start", "length", "ids_crc32",
        F.pmod(F.xxhash64(F.lit(turn), "_id", "piece", "ids_crc32"), F.lit(partitions)).alias("_part"),
    )
    return dealt.groupBy("_part").applyInArrow(pack, PACKED)


def _bins(df: DataFrame) -> int:
    return df.where(F.col("offset") == 0).count()


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, max_turns: int = 12) -> DataFrame:
    """The pieces (as ``token_pieces`` makes them) with sequence_id and offset."""
    pieces = checkpointed(pieces)
    partitions = max(1, -(-pieces.count() // partition_pieces))
    current = checkpointed(_packed(pieces, partitions, 0, capacity))
    settled: list[DataFrame] = []
    for turn in range(1, max_turns):
        if partitions == 1:
            break
        pool = current.where("_gap")
        open_pieces, open_bins = pool.count(), _bins(pool)
        if not open_pieces:
            break
        partitions = min(partitions - 1, max(1, -(-open_pieces // partition_pieces)))
        again = checkpointed(_packed(pool, partitions, turn, capacity))
        if _bins(again) >= open_bins:
            break
        settled.append(current.where("NOT _gap"))
        current = again
    for done in settled:
        current = current.unionByName(done)
    return current


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    partition_pieces: int = PARTITION_PIECES,
) -> DataFrame:
    """One row per piece: its document, place there, length, CRC of its ids, and its
    sequence and offset."""
    vocabulary = vocabulary or public_path("byte_bpe_50k.json")
    packed = pack(token_pieces(docs, vocabulary, id_col, text_col, capacity, end_id), capacity, partition_pieces)
    return packed.select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
