"""Directories: counts, listings, previews, and the rows that an expanded tree shows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, paths


def entries(manifest: DataFrame) -> DataFrame:
    """(rel, name, parent, kind) of all files and directories of a manifest of files."""
    dirs = manifest.select(F.explode(paths.ancestors(F.col("rel"))).alias("rel")).distinct().withColumn("kind", F.lit("dir"))
    both = manifest.select("rel").withColumn("kind", F.lit("file")).unionByName(dirs)
    return both.withColumn("name", paths.name(F.col("rel"))).withColumn("parent", paths.parent(F.col("rel")))


def counts(tree: DataFrame) -> DataFrame:
    """(parent, files, dirs) without bookkeeping entries; all that is no directory counts as a file."""
    own = tree.where(~dims.is_metadata(F.col("name")))
    return own.groupBy("parent").agg(F.count_if(F.col("kind") != "dir").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"))


def subdir_counts(tree: DataFrame) -> DataFrame:
    """(path, subdirs) of every directory, bookkeeping ones counted."""
    dirs = tree.where("kind = 'dir'")
    n = dirs.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    return dirs.select(F.col("rel").alias("path")).join(n, F.col("path") == F.col("parent"), "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("subdirs"))


def preview(tree: DataFrame, most: int = 10) -> DataFrame:
    """(parent, place, name, more): the first files of each directory by name, and how many follow."""
    own = tree.where((F.col("kind") != "dir") & ~dims.is_metadata(F.col("name")))
    total = own.groupBy("parent").agg(F.count(F.lit(1)).alias("total"))
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("name", "rel"))).where(F.col("place") <= most)
    return ranked.join(total, "parent").select("parent", "place", "name", F.greatest(F.col("total") - most, F.lit(0)).alias("more"))


def listing(tree: DataFrame, parent: str) -> DataFrame:
    """(place, name) of a directory's subdirectories, case ignored; bookkeeping ones are shown."""
    own = tree.where((F.col("kind") == "dir") & (F.col("parent") == parent))
    return own.select((F.row_number().over(Window.partitionBy("parent").orderBy(paths.folded(F.col("name")), "name")) - 1).alias("place"), "name")


def children(tree: DataFrame, parent: str) -> DataFrame:
    """(place, name) of a directory's subdirectories, upper case before lower; bookkeeping ones are left out."""
    own = tree.where((F.col("kind") == "dir") & (F.col("parent") == parent) & ~dims.is_metadata(F.col("name")))
    return own.select((F.row_number().over(Window.partitionBy("parent").orderBy("name")) - 1).alias("place"), "name")


def page(names: DataFrame, offset: int, height: int) -> DataFrame:
    """The rows of a listing that a window of this height shows from an offset on."""
    return names.where((F.col("place") >= offset) & (F.col("place") < offset + height))


def expand(expanded: Iterable[str], dirs: DataFrame, path: str) -> set[str]:
    """The expanded directories with one more, if it has a subdirectory to show; else nothing happens."""
    held = set(expanded)
    below = dirs.where((F.col("kind") == "dir") & (F.col("parent") == path) & ~dims.is_metadata(F.col("name")))
    return held if below.isEmpty() else held | {path}


def collapse(expanded: Iterable[str], path: str) -> tuple[set[str], str]:
    """The expanded directories and the cursor: an expanded directory is shut; of one that is shut already its parent, to which the cursor goes."""
    held = set(expanded)
    if path in held:
        return held - {path}, path
    up = path.rpartition("/")[0]
    return (held - {up}, up) if up else (held, path)


def jump(names: DataFrame, cursor: int, letter: str) -> DataFrame:
    """The next row of a listing after the cursor, around the end, whose name begins with the letter, case ignored."""
    n = names.agg(F.count(F.lit(1)).alias("n"))
    hit = names.where(paths.folded(F.substring("name", 1, 1)) == paths.folded(F.lit(letter)))
    return hit.join(F.broadcast(n)).orderBy(F.pmod(F.col("place") - F.lit(cursor + 1), F.col("n"))).limit(1).select("place", "name")


def visible(tree: DataFrame, expanded: DataFrame) -> DataFrame:
    """Directories all of whose ancestors are expanded (path), without bookkeeping ones."""
    dirs = tree.where("kind = 'dir'").where(~F.exists(paths.parts(F.col("rel")), dims.is_metadata)).select("rel")
    up = dirs.select("rel", F.explode(paths.ancestors(F.col("rel"))).alias("path"))
    shut = up.join(expanded.select("path").distinct(), "path", "left_anti").select("rel").distinct()
    return dirs.join(shut, "rel", "left_anti")


def effectively_excluded(dirs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """dirs (path) with excluded: whether it or an ancestor is in the exclusions."""
    chain = dirs.select("path", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("up"))
    hit = chain.join(exclusions.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct().withColumn("excluded", F.lit(True))
    return dirs.join(hit, "path", "left").select("path", F.coalesce("excluded", F.lit(False)).alias("excluded"))
