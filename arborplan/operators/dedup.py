"""Files with equal content, found by size, then the hash of the head, then the hash of the whole.

Contents are hashed where they are read: shuffles carry numbers and hashes only. Which files to read a step says in a broadcast table of cells,
whose size is bounded; a file that only shares a cell with a wanted one is read for nothing and then left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD = 65536
#: Rows that the broadcast table of cells has at most.
CELLS = 1 << 20
POLICIES = ("skip", "all", "cancel")


def by_size(files: DataFrame) -> DataFrame:
    """files (seq, size, no content) that share a positive size with another."""
    kept = files.where("size > 0")
    return kept.withColumn("n_size", F.count(F.lit(1)).over(Window.partitionBy("size"))).where("n_size > 1").drop("n_size")


def _cell(key: Column) -> Column:
    return F.pmod(key, F.lit(CELLS)).cast("int")


def _read(files: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Readable files whose key (a number) is that of a wanted row, or shares its cell."""
    cells = wanted.select(_cell(F.col(key)).alias("cell")).distinct()
    return files.where("content is not null").join(F.broadcast(cells), _cell(F.col(key)) == F.col("cell"), "left_semi")


def heads(files: DataFrame, head: int = HEAD) -> DataFrame:
    """(seq, size, head_hash) of files (seq, size, content) that share a size with another. Unreadable ones (null content) drop out."""
    same = by_size(files.select("seq", "size"))
    hashed = _read(files.where("size > 0"), same, "size").select("seq", "size", F.sha2(F.substring("content", 1, head), 256).alias("head_hash"))
    return hashed.join(same.select("seq"), "seq", "left_semi")


def by_head(files: DataFrame, head: int = HEAD) -> DataFrame:
    """(seq, size, head_hash) of files that share size and head with another."""
    return heads(files, head).withColumn("n_head", F.count(F.lit(1)).over(Window.partitionBy("size", "head_hash"))).where("n_head > 1").drop("n_head")


def with_full(files: DataFrame, partial: DataFrame, head: int = HEAD) -> DataFrame:
    """partial with full_hash; a file no longer than the head isn't hashed again."""
    wholes = _read(files.where(F.col("size") > head), partial.where(F.col("size") > head), "seq").select("seq", F.sha2("content", 256).alias("whole"))
    return partial.join(wholes, "seq", "left").select("seq", "size", F.when(F.col("size") <= head, F.col("head_hash")).otherwise(F.col("whole")).alias("full_hash"))


def members(files: DataFrame, head: int = HEAD) -> DataFrame:
    """(seq, size, keep) of every file that equals another; keep is the earliest of its set, which stays."""
    full = with_full(files, by_head(files, head), head)
    first = full.groupBy("size", "full_hash").agg(F.min("seq").alias("keep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return full.join(first, ["size", "full_hash"]).select("seq", "size", "keep")


def sets(files: DataFrame, head: int = HEAD) -> DataFrame:
    """(size, keep, skip): of each set of equal files the earliest stays. A row holds a set's numbers; plans are filtered by members."""
    return members(files, head).where("seq <> keep").groupBy("size", "keep").agg(F.array_sort(F.collect_list("seq")).alias("skip"))


def reported(found: DataFrame) -> DataFrame:
    """Sets in the order of the files that stay."""
    return found.orderBy("keep")


def summary(files: DataFrame, head: int = HEAD) -> DataFrame:
    """One row: sets, files, bytes that could be saved, and how many hashes were needed (heads and wholes)."""
    hashed = heads(files, head).agg(F.count(F.lit(1)).alias("h"))
    wholes = by_head(files, head).where(F.col("size") > head).agg(F.count(F.lit(1)).alias("w"))
    extra = F.col("seq") != F.col("keep")
    found = members(files, head).agg(F.count_if(~extra).alias("sets"), F.count_if(extra).alias("files"), F.coalesce(F.sum(F.when(extra, F.col("size"))), F.lit(0)).cast("long").alias("bytes"))
    return found.crossJoin(hashed).crossJoin(wholes).select("sets", "files", "bytes", (F.col("h") + F.col("w")).alias("hashed"))  # three rows of one


def filtered(plan: DataFrame, found: DataFrame) -> DataFrame:
    """The plan without all but the earliest of equal files (members); names stay as they were given out."""
    return plan.join(found.where("seq <> keep").select("seq"), "seq", "left_anti")


def resolved(plan: DataFrame, found: DataFrame, policy: str) -> DataFrame:
    """policy: `skip` drops duplicates, `all` keeps the plan, `cancel` copies nothing if there are duplicates. Without duplicates each keeps the plan."""
    if policy not in POLICIES:
        raise ValueError("policy must be skip, all or cancel")
    if policy == "cancel":
        return plan.limit(0) if not found.isEmpty() else plan
    return filtered(plan, found) if policy == "skip" else plan
