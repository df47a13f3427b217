"""Sharding by fixed virtual slots.

Records hash into thousands of slots, the bytes of each slot are summed, and a versioned map says which
shard holds which slot. Rebalancing edits the map: only the slots it names move.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, text_crc32, utf8

SLOTS = 4096
#: A slot with more than this part of a shard's even share of bytes is split, up to SPLITS ways.
SPLIT_SHARE = 0.25
SPLITS = 256
#: Ranks in a shard are counted in this many parts, so no task ranks a whole shard.
RANK_PARTS = 512


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds which slot. `splits`: into how many sub-slots a heavy slot is dealt. A map never changes; edits make the next version."""

    shards: int
    owner: dict[int, int]
    splits: dict[int, int] = field(default_factory=dict)
    version: int = 1

    def rebalanced(self, bytes_of: dict[int, int], tolerance: float = 0.01) -> SlotMap:
        """The next version: moves slots from the fullest shard to the emptiest while that narrows the gap beyond the tolerance."""
        owner, load = dict(self.owner), [0] * self.shards
        held: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot, shard in sorted(owner.items()):
            load[shard] += bytes_of.get(slot, 0)
            held[shard].append(slot)
        even = sum(load) / max(1, self.shards)
        while True:
            top, low = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[top] - load[low]
            fits = [s for s in held[top] if 0 < bytes_of.get(s, 0) < gap]
            if gap <= tolerance * even or not fits:
                break
            slot = min(fits, key=lambda s: (abs(gap / 2 - bytes_of[s]), s))
            held[top].remove(slot)
            held[low].append(slot)
            owner[slot] = low
            load[top] -= bytes_of[slot]
            load[low] += bytes_of[slot]
        return self if owner == self.owner else SlotMap(self.shards, owner, self.splits, self.version + 1)

    def grown(self, bytes_of: dict[int, int]) -> SlotMap:
        """The next version with one more shard, to which the others give slots; no slot moves between old shards."""
        more, owner, load = self.shards + 1, dict(self.owner), [0] * (self.shards + 1)
        for slot, shard in owner.items():
            load[shard] += bytes_of.get(slot, 0)
        even = sum(load) / more
        for slot in sorted(owner, key=lambda s: (-bytes_of.get(s, 0), s)):
            b = bytes_of.get(slot, 0)
            if b and load[owner[slot]] - b >= even * 0.999 and load[more - 1] + b <= even * 1.001:
                load[owner[slot]] -= b
                load[more - 1] += b
                owner[slot] = more - 1
        return SlotMap(more, owner, self.splits, self.version + 1)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, int(s), int(o)) for s, o in sorted(self.owner.items())]
        return spark.createDataFrame(rows, "version int, vslot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the maps under path."""
        meta = spark.createDataFrame([(None, None, self.shards), *((s, w, None) for s, w in sorted(self.splits.items()))], "vslot int, ways int, shards int")
        rows = self.table(spark).drop("version").unionByName(meta, allowMissingColumns=True)
        rows.coalesce(1).write.parquet(f"{path}/version={self.version:06d}", mode="errorifexists")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest unless said. A map has at most a row for each slot and split."""
        stored = spark.read.option("basePath", path).parquet(path)
        version = stored.agg(F.max("version")).collect()[0][0] if version is None else version
        rows = stored.where(F.col("version") == version).collect()
        shards = next(r.shards for r in rows if r.shards is not None)
        return SlotMap(shards, {r.vslot: r.shard for r in rows if r.shard is not None}, {r.vslot: r.ways for r in rows if r.ways is not None}, version)


def first_map(bytes_of: dict[int, int], shards: int, splits: dict[int, int] | None = None) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes."""
    heap, owner = [(0, s) for s in range(shards)], {}
    for slot in sorted(bytes_of, key=lambda s: (-bytes_of[s], s)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + bytes_of[slot], shard))
    return SlotMap(shards, owner, splits or {})


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds vslot0, the slot of a record's text (equal texts share it), and salt, which deals a heavy slot's records out by their id."""
    return rows.withColumn("vslot0", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(slots)).cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64(F.lit(11), F.coalesce("doc_id", F.lit(-1)), "text_crc32"), F.lit(SPLITS)).cast("int")
    )


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap, dict[int, int]]:
    """All documents with their virtual slot and shard (law `bytes`), the map, and the bytes of each slot.

    Size is the text's UTF-8 bytes plus 1; a null text has size 1. Slots x splits bounds what reaches the
    driver, whatever the input. Equal texts share a shard unless their slot alone exceeds SPLIT_SHARE of a shard's
    even part. Repeated rows each count. A null doc_id is dealt as -1. An empty table gives no rows. Columns of
    docs other than doc_id and text are not read, so clashing names are harmless. Very long texts are only measured.
    With a path each version of the map is stored under it, and rows are dealt by the latest one as it is read back.
    """
    spark = docs.sparkSession
    rows = slotted(docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), text_crc32().alias("text_crc32")), slots)
    total = rows.groupBy("vslot0").agg(F.sum("size").alias("b"))
    whole = {r.vslot0: r.b for r in total.collect()}
    even = sum(whole.values()) / shards
    splits = {s: min(SPLITS, 1 << int(b / (SPLIT_SHARE * even)).bit_length()) for s, b in sorted(whole.items()) if b > SPLIT_SHARE * even}
    if splits:
        ways = F.coalesce(F.create_map(*[F.lit(x) for kv in splits.items() for x in kv])[F.col("vslot0")], F.lit(1))
    else:
        ways = F.lit(1)
    rows = rows.withColumn("vslot", F.col("vslot0") + F.lit(slots) * F.pmod("salt", ways)).drop("vslot0", "salt")
    bytes_of = {r.vslot: r.b for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()} if splits else whole
    slot_map = first_map(bytes_of, shards, splits)
    if path:
        slot_map.store(spark, path)
        if (edited := SlotMap.load(spark, path).rebalanced(bytes_of)).version > slot_map.version:
            edited.store(spark, path)
        slot_map = SlotMap.load(spark, path)
    else:
        slot_map = slot_map.rebalanced(bytes_of)
    table = F.broadcast(slot_map.table(spark).select("vslot", "shard"))  # at most SLOTS + heavy slots x SPLITS rows
    return rows.join(table, "vslot"), slot_map, bytes_of


def ranked(rows: DataFrame) -> DataFrame:
    """Adds slot, a row's place in its shard from 0 without gaps: ranks in RANK_PARTS parts of each shard, set off by the parts' counts."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(RANK_PARTS)).cast("int"))
    counts = parts.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    out = parts.withColumn("rank", F.row_number().over(own) - 1)
    return out.join(F.broadcast(before.select("shard", "part", "before")), ["shard", "part"]).withColumn("slot", (F.coalesce("before", F.lit(0)) + F.col("rank")).cast("long")).drop("part", "rank", "before")


def op6_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = shard_documents(documents(spark, sf_dir), 8, path=f"{shared_dir(spark)}/maps/{uuid.uuid4().hex}")
    return ranked(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
