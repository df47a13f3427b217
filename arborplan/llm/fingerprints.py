"""SimHash fingerprints, and the pairs of them within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, flat, lowered, mix, ranges, word_hashes, words

BITS = 64
RADIUS = 3
#: The fingerprint is cut into so many blocks; a table for each choice of BLOCKS - RADIUS of them.
BLOCKS = 6
#: Terms whose votes are counted at once.
TERMS = 1 << 17


def simhash(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row of UTF-8 bytes.

    Terms are pairs of neighbouring words (a lone word by itself), in lower case for A to Z; a term weighs
    its count times the square of its length in bytes, taken as 24 at most, so that pairs of short common words don't
    decide. Each term's hash votes with its weight for or against each bit.
    No words: 0. A row's fingerprint depends on its text only.
    """
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, j in blocks(offsets, 1 << 19):
        part = lowered(raw[offsets[i] : offsets[j]])
        at = offsets[i : j + 1] - offsets[i]
        start, end, first = words(part, at)
        count = np.diff(first)
        terms = np.where(count == 1, 1, np.maximum(count - 1, 0))
        rows = np.flatnonzero(terms)
        if not len(rows):
            continue
        a = ranges(first[:-1][rows], terms[rows])
        b = np.minimum(a + 1, np.repeat(first[1:][rows] - 1, terms[rows]))
        own = word_hashes(part, start, end)
        row_of = np.repeat(np.arange(len(rows)), terms[rows])
        votes, weighed = np.zeros((len(rows), BITS), np.int64), np.zeros(len(rows), np.int64)
        for low in range(0, len(a), TERMS):
            x, y, r = a[low : low + TERMS], b[low : low + TERMS], row_of[low : low + TERMS]
            with np.errstate(over="ignore"):
                h = mix(own[x] * np.uint64(3) + own[y])
            weight = np.minimum(end[x] - start[x] + (y > x) * (end[y] - start[y]), 24).astype(np.int32) ** 2
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[r[cuts]] += np.add.reduceat(bits * weight[:, None], cuts, axis=0, dtype=np.int64)
            weighed[r[cuts]] += np.add.reduceat(weight, cuts, dtype=np.int64)
        out[i + rows] = np.packbits(2 * votes > weighed[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the share of bits that differ."""
    return 1 - np.bitwise_count(a ^ b).astype(np.float64) / BITS


def _texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64))), raw


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of every row; null texts count as empty, repeated rows each get a row, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash(*flat(b.column(1))).view(np.int64))], ["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("t")).mapInArrow(run, f"id {kind}, fingerprint long")


def near_pairs(prints: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """All pairs a < b of different fingerprints (unsigned order aside) at a Hamming distance up to radius, with the distance.

    Pairs are of distinct fingerprints, so copies cost nothing; membership is the input itself. Two fingerprints
    within the radius agree on n_blocks - radius whole blocks, so some table's key finds them. Each table's key
    is those blocks; a pair is kept in the first table that finds it, so it comes once. Null fingerprints are left out; an empty table gives no rows.
    """
    if n_blocks <= radius:
        raise ValueError("n_blocks must be above radius")
    each, spare = divmod(BITS, n_blocks)
    edges, at = [], 0
    for i in range(n_blocks):
        width = each + (i < spare)
        edges.append(((1 << width) - 1) << at)
        at += width
    masks = [sum(edges[i] for i in kept) for kept in combinations(range(n_blocks), n_blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    once = prints.select("fingerprint").where("fingerprint is not null").distinct()
    keyed = once.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("table", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    differs = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in signed]), F.col("a.table") + 1)
    found = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fingerprint") < F.col("b.fingerprint")) & (F.bit_count(differs) <= radius) & (differs.bitwiseAND(mask) == 0))
    earlier = F.lit(True)
    for i, m in enumerate(signed):
        earlier = earlier & ((F.col("a.table") <= i) | (differs.bitwiseAND(F.lit(m).cast("long")) != 0))
    return found.where(earlier).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"), F.bit_count(differs).alias("distance"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to chunks of the doc_id order, each chunk sorted and followed by the first row of the next (ahead = 1).

    Chunk bounds are quantiles of doc_id, one for each shuffle partition; the driver gets a row for each chunk.
    Equal doc_ids stand in the order of their text's hash; null ones come first.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(low).cast("long")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.unique(np.array(rows.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) or [0.0])) if n > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def chunk_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.float64), "right").astype(np.int32))

    dealt = rows.withColumn("chunk", chunk_of("k"))
    # Ties are told apart by a hash of the text; only tied first rows need it, and it is cheap to make for all.
    dealt = dealt.withColumn("h", F.xxhash64("text"))
    heads = sorted((r.chunk, r.m.k, r.m.h) for r in dealt.groupBy("chunk").agg(F.min(F.struct("k", "h")).alias("m")).collect())
    before = {(k, h): heads[i - 1][0] for i, (_, k, h) in enumerate(heads)}
    table = spark.createDataFrame([(k, h, c) for (k, h), c in before.items()] or [(0, 0, -1)], "hk long, hh long, to int")
    heads_df = F.broadcast(table)  # a row for each chunk
    out = dealt.join(heads_df, (F.col("k") == F.col("hk")) & (F.col("h") == F.col("hh")), "left")
    here = F.struct(F.col("chunk").alias("chunk"), F.lit(0).alias("ahead"))
    there = F.struct(F.col("to").alias("chunk"), F.lit(1).alias("ahead"))
    out = out.select("doc_id", "k", "h", "text", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
    return out.select("doc_id", "k", "h", "text", "at.chunk", "at.ahead").repartition(n, "chunk").sortWithinPartitions("chunk", "ahead", "k", "h")


_DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None

    def done(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, nexts = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts, strict=True)]
        raw, at, _ = _texts(texts)
        own = simhash(raw, at)
        # The next row's text is the following text, except where a chunk ends.
        after = np.concatenate((own[1:], own[:1]))
        if odd := [i for i in range(len(rows)) if i + 1 == len(rows) or texts[i + 1] is not nexts[i]]:
            raw, at, _ = _texts([nexts[i] for i in odd])
            after[odd] = simhash(raw, at)
        raw, at, each = _texts(edited)
        ed = simhash(raw, at)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in each]),
             pa.array([f"{x:016x}" for x in own.tolist()]), pa.array([f"{x:016x}" for x in ed.tolist()]), pa.array(likeness(own, ed)), pa.array(likeness(own, after))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    ready: list[tuple] = []
    size = 0
    for b in batches:
        for doc_id, text, chunk, ahead in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if held is not None and held[2] == chunk:
                ready.append((held[0], held[1], text))
                size += len(held[1]) + 64
            held = None if ahead else (doc_id, text, chunk)
            if size > 1 << 21:
                yield done(ready)
                ready, size = [], 0
    if ready:
        yield done(ready)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    An empty table gives no rows; a single document is its own next one; null and empty texts have the fingerprint 0; repeated rows and
    equal ids each get a row, in the order of their texts' hashes; very long texts vote in parts; columns beside doc_id and text are not read.
    """
    return with_next(docs).select("doc_id", "text", "chunk", "ahead").mapInArrow(_edited, _DIGEST)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
