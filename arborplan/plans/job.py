"""A whole job: scan, prune, plan, drop duplicates, copy. `python -m arborplan.plans.job inspect DIR` lists a directory's metadata."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, extract, plan
from ..sources import copy, store, tree


@dataclass(frozen=True)
class JobSpec:
    source: str
    target: str = ""
    excluded: frozenset[str] = frozenset()  # relative to the source
    mode: str = "flat"  # or organize
    keep_tree: bool = False
    duplicates: str = "all"  # or skip or cancel
    stall_s: float = copy.STALL_S

    def with_source(self, source: str) -> JobSpec:
        """Another source has other directories: exclusions and target are forgotten."""
        return replace(self, source=source, excluded=frozenset(), target="")

    def checked(self) -> JobSpec:
        target = self.target or default_target(self.source)
        if within(self.source, target) or within(target, self.source):
            raise ValueError("source and target overlap")
        if self.mode not in ("flat", "organize") or self.duplicates not in dedup.POLICIES:
            raise ValueError("mode is flat or organize, duplicates is all, skip or cancel")
        return replace(self, target=target)


def within(a: str, b: str) -> bool:
    """Whether a is b or below it, case ignored."""
    x, y = (os.path.normpath(p).lower().rstrip("/") for p in (a, b))
    return x == y or x.startswith(y + "/")


def valid_name(name: str) -> bool:
    n = name.strip()
    return n not in ("", ".", "..") and "/" not in n and "\\" not in n


def safe_base(path: str) -> str:
    n = os.path.basename(os.path.normpath(path))
    return n if n not in ("", ".", "..", "/") else "flattened"


def default_target(source: str) -> str:
    return os.path.join(os.path.dirname(os.path.normpath(source)), safe_base(source) + "-super")


def manifest(spark: SparkSession, spec: JobSpec, stat: bool = False) -> DataFrame:
    tree.register(spark)
    df = spark.read.format("tree").option("path", spec.source).option("exclude", "\n".join(sorted(spec.excluded))).option("stat", str(stat).lower()).load()
    return df.where("kind = 'file'")


def planned(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """(seq, src, dst) as the job would copy; names are given out before duplicates go, and stay. Sizes are read only if duplicates are looked for."""
    look = spec.duplicates != "all"
    files = manifest(spark, spec, look).withColumn("src", F.concat(F.lit(spec.source.rstrip("/") + "/"), F.col("rel")))
    rows = plan.ordered(files)
    named = plan.organised(rows, spec.keep_tree) if spec.mode == "organize" else plan.flattened(rows)
    out = plan.assign_unique(named)
    if look:
        found, _ = copy.duplicate_files(rows.select("seq", "src", "size"), stall_s=spec.stall_s)
        out = dedup.resolved(out, found, spec.duplicates)
    return out


def run(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """Results of the copy, a row for each file, made once."""
    spec = spec.checked()
    os.makedirs(spec.target, exist_ok=True)
    return store.stored(copy.copied(planned(spark, spec), spec.target, spec.stall_s))


def inspect(spark: SparkSession, folder: str = ".") -> DataFrame:
    """Title, media type and size of the files of one directory, bookkeeping files too."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    tree.register(spark)
    files = spark.read.format("tree").option("path", folder).option("depth", "1").option("metadata", "true").option("stat", "true").option("content", "true").option("head", str(extract.SNIFF)).load()
    return extract.extracted(files.where("kind <> 'dir'")).where("error is null").drop("error").orderBy("path")


if __name__ == "__main__":
    if sys.argv[1:2] == ["inspect"]:
        session = SparkSession.builder.getOrCreate()
        try:
            inspect(session, *sys.argv[2:3]).show(1000, False)
        except NotADirectoryError as e:
            sys.exit(f"not a directory: {e}")
