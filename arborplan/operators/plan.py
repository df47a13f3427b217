"""From a manifest (rel, a path for each file) to a plan (seq, src, dst)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, paths
from ..sources import store


def numbered(df: DataFrame, *order: Column, name: str = "seq", parts: int | None = None) -> DataFrame:
    """Adds 0, 1, 2, ... in the given order, without one task that sees all rows: places in sorted ranges, set off by the ranges' counts.

    The ranges are stored once, so the numbers stand even if a range would be cut otherwise when an executor is lost or the input changes.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("k"))
    ranged = store.stored(rows.repartitionByRange(n, "k").sortWithinPartitions("k").select("row", F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # a row for each range
    out = ranged.join(F.broadcast(before), part == F.col("part"))
    return out.select("row.*", (F.col("before") + place).cast("long").alias(name))


def pruned(manifest: DataFrame) -> DataFrame:
    """Without bookkeeping files and what bookkeeping directories hold."""
    return manifest.where(~F.exists(paths.parts(F.col("rel")), dims.is_metadata))


def without_subtrees(manifest: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Without files below an excluded directory (path); every ancestor is looked up by equality. rel must be unique."""
    up = manifest.select("rel", F.explode(paths.ancestors(F.col("rel"))).alias("path"))
    hit = up.join(exclusions.select("path").distinct(), "path", "left_semi").select("rel").distinct()
    return manifest.join(hit, "rel", "left_anti")


def antichain(exclusions: DataFrame) -> DataFrame:
    """Exclusions without those below another."""
    up = exclusions.select("path", F.explode(paths.ancestors(F.col("path"))).alias("up"))
    covered = up.join(exclusions.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct()
    return exclusions.select("path").distinct().join(covered, "path", "left_anti")


def toggled(exclusions: Iterable[str], path: str) -> set[str]:
    """The set after one flip: nothing happens under an excluded directory; what is added makes excluded ones below it needless."""
    held = set(exclusions)
    up = path.split("/")
    if any("/".join(up[:i]) in held for i in range(1, len(up))):
        return held
    if path in held:
        return held - {path}
    return {p for p in held if not p.startswith(path + "/")} | {path}


def ordered(manifest: DataFrame, *ties: Column) -> DataFrame:
    """With seq, the place in a depth-first walk whose directories are read in name order."""
    return numbered(manifest, paths.parts(F.col("rel")), *ties)


def organised(manifest: DataFrame, keep_tree: bool = False) -> DataFrame:
    """With dst: category, extension folder, with keep_tree the file's own directory, name."""
    own = paths.name(F.col("rel"))
    df = dims.with_category(manifest.withColumn("ext", paths.extension(own)))
    steps = [F.col("category"), paths.ext_folder(F.col("ext"))]
    if keep_tree:
        below = paths.rel_dir(F.col("rel"))
        steps.append(F.when(below != "", below))  # concat_ws leaves nulls out
    return df.withColumn("dst", F.concat_ws("/", *steps, own))


def flattened(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("dst", paths.flat_name(F.col("rel")))


def family(dst: Column) -> Column:
    """Names can only clash with names of their own family: the base without counters, and the extension."""
    ext = paths.last_dot_ext(dst)
    base = F.substr(dst, F.lit(1), F.char_length(dst) - F.char_length(ext))
    return F.concat(F.regexp_replace(paths.folded(base), "(_[0-9]+)+$", ""), F.lit("|"), paths.folded(ext))


_COUNTED = re.compile(r"(.*)_([1-9][0-9]*)", re.S)


class Names:
    """Names of one family given out in turn: each takes itself, or itself with the first free counter before its extension.

    Held are the names that took themselves, and for each base the next counter to try: all counters before it are taken, so the
    names made with them needn't be held.
    """

    def __init__(self) -> None:
        self.plain: set[str] = set()
        self.next_of: dict[tuple[str, str], int] = {}

    def give(self, name: str, key: str, base: str, ext: str, base_key: str, ext_key: str) -> str:
        """key, base_key and ext_key are folded to lower case."""
        made = _COUNTED.fullmatch(base_key)
        if key not in self.plain and not (made and int(made[2]) < self.next_of.get((made[1], ext_key), 1)):
            self.plain.add(key)
            return name
        i = self.next_of.get((base_key, ext_key), 1)
        while f"{base_key}_{i}{ext_key}" in self.plain:
            i += 1
        self.next_of[base_key, ext_key] = i + 1
        return f"{base}_{i}{ext}"


def unique_names(names: list[str], keys: list[str], bases: list[str], exts: list[str], base_keys: list[str], ext_keys: list[str]) -> list[str]:
    """The names of one family, given out in turn."""
    own = Names()
    return [own.give(*row) for row in zip(names, keys, bases, exts, base_keys, ext_keys, strict=True)]


def assign_unique(plan: DataFrame) -> DataFrame:
    """plan (seq, src, dst) with destinations that differ also when case is ignored, given out in the order of seq.

    A family of names stays together, for a later name depends on all earlier ones. In a family without names that have a counter already,
    the n-th row gets the counter n, in the JVM. The other families run through Python in the order of seq, batch by batch.
    """
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ext = paths.last_dot_ext(F.col("dst"))
    base = F.substr(F.col("dst"), F.lit(1), F.char_length("dst") - F.char_length(ext))
    own = Window.partitionBy("family")
    df = plan.select("seq", "src", "dst", family(F.col("dst")).alias("family"), base.alias("b"), ext.alias("e")).withColumn("bk", paths.folded(F.col("b")))
    df = df.withColumn("counted", F.max(F.col("bk").rlike("_[0-9]+$")).over(own)).withColumn("place", F.row_number().over(own.orderBy("seq")) - 1)
    plain = df.where("not counted").select("seq", "src", F.when(F.col("place") == 0, F.col("dst")).otherwise(F.concat("b", F.lit("_"), F.col("place").cast("string"), "e")).alias("dst"))
    rest = df.where("counted").select("seq", "src", "dst", "family", paths.folded(F.col("dst")).alias("k"), "b", "e", "bk", paths.folded(F.col("e")).alias("ek"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, names = None, Names()
        for rows in batches:
            out = []
            for own_family, *row in zip(*(rows[c] for c in ("family", "dst", "k", "b", "e", "bk", "ek")), strict=True):
                if own_family != held:
                    held, names = own_family, Names()
                out.append(names.give(*row))
            yield pd.DataFrame({"seq": rows["seq"], "src": rows["src"], "dst": out})

    given = rest.repartition(n, "family").sortWithinPartitions("family", "seq").mapInPandas(fold, "seq long, src string, dst string")
    return plain.unionByName(given)
