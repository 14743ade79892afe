"""Sharding over fixed virtual slots (DataFrame functions on the data path).

Every record is hashed into one of a few thousand virtual slots, for good: the slot of a
record (its id and text) never changes. What can change is the slot-to-shard map, a versioned
table of one entry per slot. Bytes are summed per slot, and rebalancing edits the stored map:
slots move (or swap) from the heaviest shard to the lightest until no edit lowers the spread,
and the edited map is stored as the next version; a map that is in balance stays in force. A
version, once stored, is never written again. Only the map, whose size is the number of slots,
is ever on the driver.

Law: ``bytes`` - the shards' sizes are near equal.

A record's place in its shard is the number of records in the shard's earlier virtual slots
plus its rank within its own. Slots with far more rows than others - records that repeat very
often in id and text - are ranked in ``SALTS`` parts, so no task sorts a whole hot slot.

Defined results: a null text has no bytes (size 8, CRC 0); a null id hashes like any other
value; records equal in id and text share a virtual slot; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, new_folder

SLOTS = 8192
#: Bytes that a record costs beside its text.
OVERHEAD = 8
#: A slot with more than so many times the mean number of rows is hot; parts of a hot slot.
HOT, SALTS = 16, 256


@dataclass(frozen=True)
class SlotMap:
    """Version of the slot-to-shard map; ``shard_of[s]`` is the shard of virtual slot s."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def initial(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None, tolerance: float = 0.0005) -> SlotMap:
        """The next version: few edits of this one, after which shard sizes differ by at most
        ``tolerance`` of their mean, or as little as single moves and swaps can reach."""
        shards = shards or self.shards
        shard_of = [s if s < shards else s % shards for s in self.shard_of]
        held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(shard_of):
            if size := slot_bytes.get(slot, 0):
                bisect.insort(held[shard], (size, slot))
        load = [sum(size for size, _ in own) for own in held]
        close = tolerance * sum(load) / shards

        def move(slot: tuple[int, int], a: int, b: int) -> None:
            held[a].remove(slot)
            bisect.insort(held[b], slot)
            load[a] -= slot[0]
            load[b] += slot[0]
            shard_of[slot[1]] = b

        for _ in range(64 * shards + len(shard_of)):
            high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
            gap = load[high] - load[low]
            if gap <= close:
                break
            # Best single move: the slot whose size is nearest half the gap.
            best, what = gap, None
            at = bisect.bisect_left(held[high], (gap // 2, -1))
            for one in held[high][max(0, at - 1) : at + 1]:
                if abs(gap - 2 * one[0]) < best:
                    best, what = abs(gap - 2 * one[0]), (one, None)
            # Best swap: each slot of the heavy shard against its nearest counterpart.
            for one in held[high]:
                at = bisect.bisect_left(held[low], (one[0] - gap // 2, -1))
                for other in held[low][max(0, at - 1) : at + 1]:
                    if abs(gap - 2 * (one[0] - other[0])) < best:
                        best, what = abs(gap - 2 * (one[0] - other[0])), (one, other)
            if what is None:
                break
            move(what[0], high, low)
            if what[1]:
                move(what[1], low, high)
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as (version, virtual_slot, shard), from literals alone."""
        listed = ",".join(map(str, self.shard_of))
        return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ","))).select(
            F.lit(self.version).alias("version"), F.col("pos").alias("virtual_slot"), F.col("col").cast("int").alias("shard")
        )

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the map's table; one that is there already is an error."""
        self.frame(spark).drop("version").coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest by default."""
        table = spark.read.parquet(folder)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).select("virtual_slot", "shard").collect()
        of = dict((r[0], r[1]) for r in rows)
        return SlotMap(version, max(of.values()) + 1, tuple(of[s] for s in range(len(of))))

    @staticmethod
    def current(spark: SparkSession, folder: str, shards: int, slots: int = SLOTS) -> SlotMap:
        """The map in force; where none is stored, the initial one, which then is."""
        try:
            found = SlotMap.load(spark, folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = SlotMap.initial(shards, slots)
            found.save(spark, folder)
        if len(found.shard_of) != slots:
            raise ValueError(f"the map at {folder} has {len(found.shard_of)} slots, not {slots}")
        return found


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per record: id, size, CRC of the text and the virtual slot."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def assign_shards(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    map_folder: str | None = None,
) -> DataFrame:
    """Every record with its shard under the map in force, rebalanced first if its shards are
    out of balance or another number is asked for, and its place in the shard. The map is
    stored at ``map_folder``, or in a fresh folder under the shared one.
    """
    spark = docs.sparkSession
    # Light rows, kept: a record has one number, and texts are read once.
    records = checkpointed(sized(docs, id_col, text_col, slots).withColumn("_at", F.monotonically_increasing_id()))
    # One row per slot, bounded by `slots`.
    per_slot = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    size_of, rows_of = {r["virtual_slot"]: r["bytes"] for r in per_slot}, {r["virtual_slot"]: r["rows"] for r in per_slot}

    folder = map_folder or new_folder(spark, "slot-map")
    before = SlotMap.current(spark, folder, shards, slots)
    now = before.rebalanced(size_of, shards)
    if now.shard_of == before.shard_of:
        now = before
    else:
        now.save(spark, folder)

    # Hot slots, fewer than slots / HOT of them, are counted in parts.
    hot = sorted(s for s, n in rows_of.items() if n * slots > HOT * sum(rows_of.values()))
    salt = F.when(F.col("virtual_slot").isin(hot), F.pmod(F.xxhash64("_at"), F.lit(SALTS))).otherwise(0).cast("int") if hot else F.lit(0)
    records = records.withColumn("_salt", salt)
    parts: dict[int, dict[int, int]] = {s: {0: n} for s, n in rows_of.items()}
    if hot:
        parts |= {s: {} for s in hot}
        for r in records.where(F.col("virtual_slot").isin(hot)).groupBy("virtual_slot", "_salt").count().collect():
            parts[r["virtual_slot"]][r["_salt"]] = r["count"]
    begin, places = [0] * shards, []
    for slot, shard in enumerate(now.shard_of):
        for k, n in sorted(parts.get(slot, {}).items()):
            places.append(f"{slot},{k},{shard},{begin[shard]}")
            begin[shard] += n
    # A literal of a few numbers per slot: at most a few hundred KB, and SALTS entries more per hot slot.
    one = F.split("place", ",")
    bases = spark.range(1).select(F.explode(F.split(F.lit(";".join(places)), ";")).alias("place")).where("place <> ''").select(
        one[0].cast("int").alias("virtual_slot"), one[1].cast("int").alias("_salt"), one[2].cast("int").alias("shard"), one[3].cast("long").alias("_base")
    )
    within = Window.partitionBy("virtual_slot", "_salt").orderBy("_id", "text_crc32", "size")
    return (
        records.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), ["virtual_slot", "_salt"])
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_base") + F.col("_rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(now.version).alias("map_version"),
        )
    )
