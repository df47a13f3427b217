"""A directory tree as a table: spark.read.format("tree").option("path", ...).load().

Options: path; exclude, directories relative to the path, one to a line, never opened; metadata (default false): whether
bookkeeping entries are listed; stat (default false): whether size, mtime and mode are read; content (default false): whether
files are read; head: read only so many bytes of each; dirs (default false): whether directories are rows; depth: levels to read. Partitions are entries, bundled:
the driver lists directories level by level until there are `bundles` entries (64 unless said), so that one large subtree is split too. Unreadable directories are left out; so a missing path gives no rows.
"""

from __future__ import annotations

import datetime
import os
import stat as st
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import dims

SCHEMA = "rel string, name string, kind string, size long, mtime timestamp, mode int, content binary"


def is_metadata(name: str) -> bool:
    low = name.lower()
    return low.startswith("._") or low in dims.METADATA_NAMES


class Bundle(InputPartition):
    def __init__(self, names: list[tuple[str, int, bool]]) -> None:
        self.names = names


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        flag = lambda k: options.get(k, "false").lower() == "true"
        self.root = options["path"].removeprefix("file://")
        self.exclude = {p.strip("/") for p in options.get("exclude", "").split("\n") if p.strip("/")}
        self.metadata, self.stat, self.content, self.dirs = flag("metadata"), flag("stat"), flag("content"), flag("dirs")
        self.depth = int(options.get("depth", "0")) or None
        self.bundles = int(options.get("bundles", "64"))
        self.head = int(options.get("head", "-1"))

    def below(self, rel: str) -> list[str]:
        """What a directory holds, by name; nothing if it can't be read."""
        try:
            return [f"{rel}/{n}" if rel else n for n in sorted(os.listdir(os.path.join(self.root, rel)))]
        except OSError:
            return []

    def partitions(self) -> list[InputPartition]:
        done: list[tuple[str, int, bool]] = []  # directories that the driver has opened
        here, level = self.below(""), 1
        while 0 < len(done) + len(here) < self.bundles and (self.depth is None or level < self.depth):
            folders = [r for r in here if self.opened(r)]
            if not folders:
                break
            rest = set(here) - set(folders)
            done += [(r, level, True) for r in folders] + [(r, level, False) for r in sorted(rest)]
            here, level = [x for r in folders for x in self.below(r)], level + 1
        found = done + [(r, level, False) for r in here]
        n = max(1, min(self.bundles, len(found)))
        return [Bundle(found[i::n]) for i in range(n)]

    def opened(self, rel: str) -> bool:
        """Whether it is a directory that a scan goes into."""
        path = os.path.join(self.root, rel)
        if (not self.metadata and is_metadata(rel.rsplit("/", 1)[-1])) or rel in self.exclude:
            return False
        return os.path.isdir(path) and not os.path.islink(path)

    def read(self, partition: Bundle) -> Iterator[tuple]:
        todo = list(reversed(partition.names))
        while todo:
            rel, level, known = todo.pop()
            name, path = rel.rsplit("/", 1)[-1], os.path.join(self.root, rel)
            if not self.metadata and is_metadata(name):
                continue
            try:
                mode = os.lstat(path).st_mode if self.stat else None
                folder = os.path.isdir(path) and not os.path.islink(path)
                regular = os.path.isfile(path) and not os.path.islink(path)
            except OSError:
                continue
            if folder:
                if rel in self.exclude:
                    continue
                if self.dirs:
                    yield (rel, name, "dir", None, None, mode, None)
                if not known and (self.depth is None or level < self.depth):
                    todo += [(r, level + 1, False) for r in reversed(self.below(rel))]
                continue
            yield self.row(rel, name, path, "file" if regular else "other")

    def row(self, rel: str, name: str, path: str, kind: str) -> tuple:
        size = mtime = mode = content = None
        try:
            if self.stat:
                s = os.lstat(path)
                size, mtime, mode = s.st_size, datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC), st.S_IMODE(s.st_mode)
            if self.content and kind == "file":
                with open(path, "rb") as f:
                    content = f.read(self.head)
        except OSError:
            pass
        return (rel, name, kind, size, mtime, mode, content)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(TreeSource)
