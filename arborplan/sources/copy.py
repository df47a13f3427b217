"""Carrying a plan out: files are copied in tasks, and each file has a result row. Paths must be reachable from the executors."""

from __future__ import annotations

import hashlib
import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

# Chunks of 256 KiB; files from 8 MiB on are copied in chunks; a minute without a byte is a stall; looked at each 100 ms.
CHUNK = 256 * 1024
LARGE = 8 * 1024 * 1024
STALL_S = 60.0
POLL_S = 0.1


class Stalled(Exception):
    """No byte moved for so many seconds."""


def watched(job: Callable[[Callable[[int], None], threading.Event], int | str], stall_s: float) -> int | str:
    """job's result; it calls its first argument as bytes move and stops when its second is set. With 0 nothing watches.

    A job that makes no progress for stall_s is left behind: a blocked read can't be stopped, so its thread ends by itself.
    """
    if stall_s <= 0:
        return job(lambda n: None, threading.Event())
    moved, gone, out = [0], threading.Event(), []

    def tell(n: int) -> None:
        moved[0] += n

    def run() -> None:
        try:
            out.append((job(tell, gone), None))
        except BaseException as e:  # noqa: BLE001  handed over to the waiting side
            out.append((None, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    seen, since = 0, time.monotonic()
    while True:
        t.join(min(POLL_S, stall_s / 2))
        if out:
            value, error = out[0]
            if error is not None:
                raise error
            return value
        if moved[0] != seen:
            seen, since = moved[0], time.monotonic()
        elif time.monotonic() - since >= stall_s:
            gone.set()
            raise Stalled(f"no data for {stall_s:g}s")


def copy_file(src: str, dst: str, stall_s: float = STALL_S) -> int:
    """Copies bytes, permission bits and modification time; the target appears whole or not at all, and a rerun of the task makes the same file."""
    part = f"{dst}.{uuid.uuid4().hex}.part"

    def job(tell: Callable[[int], None], gone: threading.Event) -> int:
        with open(src, "rb", buffering=0) as f:  # a buffered read would wait for a whole chunk, and a slow source would look stalled
            info = os.fstat(f.fileno())
            with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, info.st_mode & 0o777), "wb") as g:
                if stall_s <= 0 and info.st_size < LARGE:
                    shutil.copyfileobj(f, g)
                else:
                    while not gone.is_set() and (data := f.read(CHUNK)):
                        g.write(data)
                        tell(len(data))
                n = g.tell()
        if gone.is_set():
            os.unlink(part)
            return 0
        try:
            os.utime(part, ns=(time.time_ns(), info.st_mtime_ns))
        except OSError:
            pass
        os.replace(part, dst)
        return n

    try:
        return int(watched(job, stall_s))
    except BaseException:
        for p in (part, dst):
            try:
                os.unlink(p)
            except OSError:
                pass
        raise


def copied(plan: DataFrame, target: str, stall_s: float = STALL_S) -> DataFrame:
    """(seq, src, dst, bytes, error_class, error) for each row of a plan: failures are rows and stop nothing.

    Speculative tasks would copy twice; turn speculation off for the job that runs this.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set[str] = set()
        for b in batches:
            rows = []
            for seq, src, dst in zip(b["seq"], b["src"], b["dst"], strict=True):
                path = os.path.join(target, dst)
                try:
                    folder = os.path.dirname(path)
                    if folder not in made:
                        os.makedirs(folder, exist_ok=True)
                        made.add(folder)
                    rows.append((seq, src, dst, copy_file(src, path, stall_s), None, None))
                except Stalled as e:
                    rows.append((seq, src, dst, 0, "STALL", str(e)))
                except OSError as e:
                    rows.append((seq, src, dst, 0, type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=["seq", "src", "dst", "bytes", "error_class", "error"])

    return plan.select("seq", "src", "dst").mapInPandas(run, "seq long, src string, dst string, bytes long, error_class string, error string")


def hash_file(path: str, limit: int = -1, stall_s: float = STALL_S) -> str:
    """SHA-256 of a file, of its first `limit` bytes if that is above 0."""

    def job(tell: Callable[[int], None], gone: threading.Event) -> str:
        h, left = hashlib.sha256(), limit if limit > 0 else None
        with open(path, "rb", buffering=0) as f:
            while not gone.is_set() and (data := f.read(CHUNK if left is None else min(CHUNK, left))):
                h.update(data)
                tell(len(data))
                if left is not None:
                    left -= len(data)
                    if not left:
                        break
        return h.hexdigest()

    return str(watched(job, stall_s))


def hashed(files: DataFrame, limit: int = -1, stall_s: float = STALL_S) -> DataFrame:
    """files (seq, src, size) with hash and error; an unreadable file has a null hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, errors = [], []
            for src in b["src"]:
                try:
                    found.append(hash_file(src, limit, stall_s))
                    errors.append(None)
                except (OSError, Stalled) as e:
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(hash=found, error=errors)

    return files.select("seq", "src", "size").mapInPandas(run, "seq long, src string, size long, hash string, error string")


def duplicate_files(files: DataFrame, head: int = 65536, stall_s: float = STALL_S) -> tuple[DataFrame, DataFrame]:
    """(members, unreadable) of files on disk (seq, src, size): only files that share a size are opened, only those that share a head are read whole.

    members: seq, size, keep, as operators.dedup says. What reading gave is stored once in the shared folder, so a lost executor has no file read again.
    """
    from ..operators import dedup

    heads = store.stored(hashed(dedup.by_size(files.select("seq", "src", "size")), head, stall_s))
    same = heads.where("hash is not null").join(heads.where("hash is not null").groupBy("size", "hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), ["size", "hash"])
    small = same.where(F.col("size") <= head).select("seq", "size", "hash")
    wholes = store.stored(hashed(same.where(F.col("size") > head), -1, stall_s))
    full = small.unionByName(wholes.where("hash is not null").select("seq", "size", "hash"))
    first = full.groupBy("size", "hash").agg(F.min("seq").alias("keep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    bad = heads.where("hash is null").select("seq", "src", "error").unionByName(wholes.where("hash is null").select("seq", "src", "error"))
    return full.join(first, ["size", "hash"]).select("seq", "size", "keep"), bad


def hash_progress(files: DataFrame, head: int = 65536) -> DataFrame:
    """(done, total) of a duplicate search over files (seq, size): a row for each candidate that is hashed, and the last with done = total. Without candidates 0 of 0."""
    from ..operators import dedup

    total = dedup.by_size(files.select("seq", "size")).agg(F.count(F.lit(1)).alias("total"))
    return total.select(F.explode(F.sequence(F.least(F.lit(1), "total"), "total")).alias("done"), "total")
