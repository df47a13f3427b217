"""A byte-level convolutional network in numpy that scores whole documents for quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import blocks, boxed, documents, flat, lean, unboxed, utf8
from .samples import held_out, labelled

FILTERS = 16
SPAN = 3
#: A chunk is two halves; chunks overlap by one.
HALF = 128
HIDDEN = 16
#: A byte recurs if the four bytes that end at it stood up to so many bytes before.
LAGS = range(2, 41)
#: Bytes of a text that are looked at together, a multiple of HALF; a longer one is worked on in parts.
LONG = 1 << 18
STEPS = 160
RATE = 0.01


def recurring(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the last four bytes stood shortly before in the same row (0 or 1 for each byte)."""
    out = np.zeros(len(raw), bool)
    if len(raw) < 8:
        return out
    x = raw.astype(np.uint32)
    four = x[3:] | x[2:-1] << 8 | x[1:-2] << 16 | x[:-3] << 24
    place = np.minimum(np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets)), 255).astype(np.uint8)
    for lag in LAGS:
        if lag < len(four):
            out[3 + lag :] |= (four[lag:] == four[:-lag]) & (place[3 + lag :] >= 3 + lag)
    return out


def halves(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the half chunks of each row (one at least), and the first half of each row (n + 1 numbers)."""
    n = np.maximum(1, -(-np.diff(offsets) // HALF))
    first = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(offsets[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * HALF, first


@dataclass
class Network:
    """filters: SPAN x 256 x FILTERS, a learned weight for each byte value at each place under each filter."""

    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray  # what a chunk's pooled filters mean, HIDDEN outputs
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    share: float | None = None  # without both labels, the one score

    @staticmethod
    def new(seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        f32 = np.float32
        return Network(r.normal(0, 0.3, (SPAN, 256, FILTERS)).astype(f32), np.zeros(FILTERS, f32), r.normal(0, 0.5, (FILTERS + 1, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32), r.normal(0, 0.5, HIDDEN).astype(f32), 0.0)

    def pooled(self, raw: np.ndarray, offsets: np.ndarray, keep: bool = False) -> tuple:
        """Each half chunk's mean filter outputs and share of recurring bytes; bytes beyond a row's end count as none."""
        n = len(raw)
        act = self.filters[0][raw] + self.bias if n else np.zeros((0, FILTERS), np.float32)
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the row's end
        for k in range(1, SPAN):
            if n > k:
                inside = left[:-k] > k
                act[:-k] += self.filters[k][raw[k:]] * (inside[:, None] if not inside.all() else np.float32(1))
        np.maximum(act, 0, out=act)
        start, first = halves(offsets)
        length = np.maximum(1, np.minimum(HALF, np.repeat(offsets[1:], np.diff(first)) - start))
        if n:
            rec = recurring(raw, offsets)
            cuts = np.minimum(start, n - 1)
            empty = np.repeat(np.diff(offsets) == 0, np.diff(first))
            # Rows are end to end, so the sums from one start to the next are the half chunks' sums.
            sums = np.zeros((len(start), FILTERS), np.float32)
            recs = np.zeros(len(start), np.float32)
            full = np.flatnonzero(~empty)
            sums[full] = np.add.reduceat(act, cuts[full], axis=0)
            recs[full] = np.add.reduceat(rec.astype(np.float32), cuts[full])
        else:
            sums, recs = np.zeros((len(start), FILTERS), np.float32), np.zeros(len(start), np.float32)
        means = np.concatenate((sums, recs[:, None]), axis=1) / length[:, None].astype(np.float32)
        return (means, length, start, first, act) if keep else (means, length, start, first)

    def long_means(self, raw: np.ndarray) -> np.ndarray:
        """The half chunks' means of one long text, LONG bytes at a time: each part is read with a half chunk before and behind it."""
        out = []
        for a in range(0, len(raw), LONG):
            low, z = max(0, a - HALF), min(len(raw), a + LONG)
            part = raw[low : min(len(raw), z + HALF)]
            skip = (a - low) // HALF
            out.append(self.pooled(part, np.array([0, len(part)]))[0][skip : skip + -(-(z - a) // HALF)])
        return np.concatenate(out)

    @staticmethod
    def chunked(means: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of two neighbouring halves of a row (a row of one half is one chunk): their means, and the right half of each."""
        right = np.arange(len(means)) + 1
        right[first[1:] - 1] -= 1  # a row's last half pairs with itself
        return (means + means[right]) / 2, right

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(offsets) - 1, self.share)
        out = np.empty(len(offsets) - 1)
        for i, j in blocks(offsets, 1 << 18):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part) > LONG:
                means = self.long_means(part)
                first = np.array([0, len(means)])
            else:
                means, _, _, first = self.pooled(part, at)
            chunks, _ = self.chunked(means, first)
            hidden = np.maximum(chunks @ self.dense + self.dense_bias, 0)
            out[i:j] = np.maximum.reduceat(hidden, first[:-1], axis=0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 3, batch: int = 48) -> Network:
    """Adam on the log loss, both labels with the same total weight. Without both labels the score is their share, 0.5 without any."""
    net = Network.new(seed)
    if len(texts) == 0 or y.min() == y.max():
        net.share = float(y.mean()) if len(texts) else 0.5
        return net
    r = np.random.default_rng(seed)
    sides = [np.flatnonzero(y == c) for c in (0, 1)]
    names = ("filters", "bias", "dense", "dense_bias", "out", "out_bias")
    m, v = ({k: np.zeros_like(np.asarray(getattr(net, k), np.float32)) for k in names} for _ in range(2))
    for step in range(1, steps + 1):
        own = np.concatenate([r.choice(s, batch // 2) for s in sides])
        parts = [np.frombuffer(texts[i], np.uint8) for i in own]
        raw, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        means, length, start, first, act = net.pooled(raw, offsets, keep=True)
        chunks, right = net.chunked(means, first)
        hidden = np.maximum(chunks @ net.dense + net.dense_bias, 0)
        top = np.maximum.reduceat(hidden, first[:-1], axis=0)
        p = 1 / (1 + np.exp(-(top @ net.out + net.out_bias)))
        d = ((p - y[own]) / len(own)).astype(np.float32)
        # The gradient goes to the chunk that gave each maximum, then to its two halves, then to their bytes.
        n_chunks, row = np.diff(first), np.repeat(np.arange(len(own)), np.diff(first))
        is_top = (hidden == top[row]) & (hidden > 0)
        is_top &= np.cumsum(is_top, axis=0) - np.repeat((np.cumsum(is_top, axis=0) - is_top)[first[:-1]], n_chunks, axis=0) == 1  # the first of equal ones
        d_hidden = is_top * (d[:, None] * net.out)[row]
        d_chunks = d_hidden @ net.dense.T / 2
        d_means = d_chunks.copy()
        np.add.at(d_means, right, d_chunks)
        size = np.diff(np.append(start, len(raw)))
        full = size > 0
        d_act = np.repeat((d_means[:, :FILTERS] / length[:, None])[full], size[full], axis=0) * (act > 0)
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(raw))
        d_filters = np.zeros_like(net.filters)
        for k in range(SPAN):
            there = np.flatnonzero(left > k)
            value = raw[there + k]
            for f in range(FILTERS):
                d_filters[k, :, f] = np.bincount(value, d_act[there, f], 256)
        grads = {"filters": d_filters, "bias": d_act.sum(0), "dense": chunks.T @ d_hidden, "dense_bias": d_hidden.sum(0), "out": top.T @ d, "out_bias": d.sum()}
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * np.square(grads[k])
            move = RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            setattr(net, k, getattr(net, k) - (move.astype(np.float32) if k != "out_bias" else float(move)))
    return net


def learn_quality(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*labelled(docs, labels, "quality", 3, 1))


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """docs with score double (0 to 1, higher: better) as a last column; null and empty texts get the score of a text without bytes.

    Every whole text is read, very long ones in parts. All columns of docs stay, whatever their names; an own column `score` of docs is replaced. Repeated rows
    each get a row, equal texts equal scores; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != "score"]
    rows = boxed(docs, "text").select("row", utf8("k0").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.scores(*flat(b.column(1))))], ["row", "score"])

    out = rows.mapInArrow(lean(run), StructType([rows.schema["row"], StructField("score", DoubleType())]))
    return out.select(*(F.col(f"row.c{i}") for i, c in enumerate(docs.columns) if c != "score"), "score").toDF(*keep, "score")


def kept(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """docs without those that score under `least`. All columns stay as they are, one named score too; else as score_quality."""
    rows = boxed(docs, "text").select("row", utf8("k0").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0]).filter(pa.array(net.scores(*flat(b.column(1))) >= least))

    return unboxed(rows.mapInArrow(lean(run), StructType([rows.schema["row"]])), docs.columns)


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
