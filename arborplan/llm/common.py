"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step works on at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables and checkpoints that all machines share: spark.checkpoint.dir. Only a driver that runs its tasks itself may go without it and gets a folder of its own."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there is None and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if sc.getCheckpointDir() is None:
        there = there or "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(there)
    return there


_open: ContextVar[list[list[str]]] = ContextVar("open_scratches", default=[])
_kept: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside go at its end, except those that are cut with keep=True; they belong to the scratch around it."""
    made: list[str] = []
    token = _open.set([*_open.get(), made])
    try:
        yield
    finally:
        _open.reset(token)
        for path in made:
            _delete(spark, path)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """df, computed once and written as a table in the shared folder; its lineage ends there.

    The table goes with the scratch it is cut in (the one around it with keep). A lazy result may still read tables outside any; those go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _open.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    else:
        _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _kept:
        with contextlib.suppress(Exception):  # the driver's JVM may be gone already
            _delete(spark, path)


def boxed(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows as one column `row` (fields c0, c1, ...), so that no helper column can clash with theirs, and the named columns as k0, k1, ..."""
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(F.struct(*plain.columns).alias("row"), *(F.col(f"c{names.index(k)}").alias(f"k{i}") for i, k in enumerate(keys)))


def unboxed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"row.c{i}") for i in range(len(names)))).toDF(*names)


def row_hash(docs: DataFrame) -> Column:
    """A hash of a boxed row's columns (maps aside), which tells repeated rows apart that differ somewhere."""
    kind = docs.schema["row"].dataType
    return F.xxhash64(*(F.col(f"row.{f.name}") for f in kind.fields if f.dataType.typeName() not in ("map", "variant")))


def utf8(col: str | Column = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.encode(F.coalesce(c, F.lit("")), "UTF-8")


def text_crc32(col: str | Column = "text") -> Column:
    return F.crc32(utf8(col))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary or string column as its bytes and the n + 1 offsets of its values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives freed memory back to the system when a task ends: workers live on beside those of the next step."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
                trim(0)

    return done


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes; each row is in one of them."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def seeded_u64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser's shape)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _steps(factor: int, size: int) -> np.ndarray:
    """1, factor, factor**2, ... modulo 2**64."""
    out = np.full(size, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(0xD6E8FEB86659FD93, -1, 1 << 64)


class Rolling:
    """Hashes of any slices of a byte block, from prefix sums modulo 2**64.

    A slice's hash depends on its bytes only, not on where it stands.
    """

    _powers = np.ones(1, np.uint64)
    _table = seeded_u64(7, 256)

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        if len(Rolling._powers) <= n:
            size = 1 << (n + 1).bit_length()
            with np.errstate(over="ignore"):
                Rolling._powers = _steps(_INVERSE, size)
        with np.errstate(over="ignore"):
            up = np.concatenate((np.zeros(1, np.uint64), self._table[raw] * _rising(n)))
            self.sums = np.cumsum(up, dtype=np.uint64)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * Rolling._powers[start] + (end - start).astype(np.uint64))


#: Longer words are hashed one by one: sums modulo 2**64 have known collisions among long strings.
LONG_WORD = 64


def hashes_to(raw: np.ndarray, start: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of a block's strings from start (ascending) to each of the ends. Sums are made for BLOCK_BYTES at a time, however long the text is."""
    out = [np.empty(len(start), np.uint64) for _ in ends]
    short = [np.minimum(e, start + LONG_WORD) for e in ends]
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + BLOCK_BYTES)))
        low = int(start[i])
        roll = Rolling(raw[low : max(int(e[i:j].max()) for e in short)])
        for own, e in zip(out, short, strict=True):
            own[i:j] = roll.slices(start[i:j] - low, e[i:j] - low)
        i = j
    for own, e, s in zip(out, ends, short, strict=True):
        for k in np.flatnonzero(e > s).tolist():
            own[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return hashes_to(raw, start, [end])[0]


_up = np.ones(1, np.uint64)


def _rising(n: int) -> np.ndarray:
    global _up
    if len(_up) < n:
        size = 1 << n.bit_length()
        with np.errstate(over="ignore"):
            _up = _steps(0xD6E8FEB86659FD93, size)
    return _up[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A to Z in lower case; all other bytes as they are."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in a block, and for each row the first of its words (n + 1 numbers)."""
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    if len(raw):
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ..."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(total)


def n_words(col: str | Column = "text") -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ the text has; null has none. Stays in the JVM."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
