"""Toxicity by multiple-instance learning: sentences are scored, and a noisy-or of them is trained on the documents' labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, flat, hashes_to, lowered, utf8
from .samples import held_out, labelled

BUCKETS = 1 << 18
STEPS = 80
RATE = 0.05
#: A feature that fewer training documents have keeps the weight 0.
LEAST_DOCS = 4
#: So many standard errors between the labels' shares of documents with a feature count as chance.
CHANCE = 3.5
#: Besides whole words, their first bytes are features, which know inflected forms.
PREFIXES = (4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and sentences of a block: word starts, word ends, each word's sentence, each row's first sentence (n + 1), sentence starts.

    A sentence ends after a full stop, exclamation or question mark or a line end; each row has one at least.
    """
    n = len(raw)
    opens = np.zeros(n + 1, bool)
    opens[1:][_STOP[raw]] = True
    opens[offsets[1:]] = False
    # An empty row has a sentence of no bytes.
    starts = np.sort(np.concatenate((np.flatnonzero(opens), offsets[:-1])), kind="stable")
    inner = np.concatenate(([0], np.cumsum(opens)))[offsets]
    first = inner + np.arange(len(offsets))
    letter = _LETTER[raw]
    a, b = letter.copy(), letter.copy()
    if n:
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        a[1:] &= ~letter[:-1] | edge[1:-1]
        b[:-1] &= ~letter[1:] | edge[1:-1]
    w_start, w_end = np.flatnonzero(a), np.flatnonzero(b) + 1
    owner = np.searchsorted(starts, w_start, "right") - 1
    return w_start, w_end, owner, first, starts


def features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashed features of each word, one column for the word and one for each prefix."""
    whole, *heads = hashes_to(raw, start, [end, *(np.minimum(end, start + k) for k in PREFIXES)])
    cols = [whole] + [h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for h, k in zip(heads, PREFIXES, strict=True)]
    return np.stack([(c % np.uint64(BUCKETS)).astype(np.int32) for c in cols], axis=1)


@dataclass
class SentenceModel:
    weights: np.ndarray
    bias: float
    #: Added to the log odds of a document before 0.5 is the bar; found on the training rows.
    shift: float = 0.0
    share: float | None = None

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each sentence's log odds, each row's first sentence, sentence starts. raw is in lower case."""
        start, end, owner, first, starts = sentences(raw, offsets)
        z = np.full(len(starts), self.bias)
        if len(start):
            z += np.bincount(owner, self.weights[features(raw, start, end)].sum(1), len(starts))
        return np.clip(z, -40, 40), first, starts

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(offsets) - 1, self.share)
        out = np.empty(len(offsets) - 1)
        for i, j in blocks(offsets):
            part, at = lowered(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
            z, first, _ = self.logits(part, at)
            clean = np.minimum(np.add.reduceat(-np.logaddexp(0, z), first[:-1]), -1e-12)
            odds = np.log(-np.expm1(clean)) - clean + self.shift  # noisy-or, as log odds
            out[i:j] = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        return out


def train(texts: list[bytes], y: np.ndarray, steps: int = STEPS) -> SentenceModel:
    """Full-batch AdaGrad on the documents' log loss, both labels with equal total weight. Without both labels the score is their share, 0.5 without any.

    A feature starts from how much likelier toxic training documents are to have it (as log odds, one taken off); one that chance explains keeps the weight 0.
    """
    model = SentenceModel(np.zeros(BUCKETS), -6.0)
    if len(texts) == 0 or y.min() == y.max():
        model.share = float(y.mean()) if len(texts) else 0.5
        return model
    raw = lowered(np.frombuffer(b"".join(texts), np.uint8))
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    start, end, owner, first, starts = sentences(raw, offsets)
    f = features(raw, start, end)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
    seen = np.unique(doc_of[owner][:, None].astype(np.int64) * BUCKETS + f)
    count, bad = np.bincount(seen % BUCKETS, minlength=BUCKETS), np.bincount(seen % BUCKETS, y[seen // BUCKETS], BUCKETS)
    known = count >= LEAST_DOCS
    n_bad, n_good = y.sum(), len(y) - y.sum()
    lean = np.log((bad + 0.5) / (n_bad + 1)) - np.log((count - bad + 0.5) / (n_good + 1))
    both = count / len(y)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_bad + 1 / n_good))
    known &= np.abs(bad / n_bad - (count - bad) / n_good) > CHANCE * error
    model.weights = np.where(known, np.sign(lean) * np.clip(np.abs(lean) - 1, 0, 4), 0.0)
    use = known[f]
    word_of, flat_f = np.repeat(owner, use.sum(1)), f[use]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    past, past_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.clip(model.bias + np.bincount(word_of, model.weights[flat_f], len(starts)), -40, 40)
        clean = np.minimum(np.add.reduceat(-np.logaddexp(0, z), first[:-1]), -1e-9)
        p = -np.expm1(clean)
        pull = np.where(y == 1, -(1 - p) / p, 1.0) * weight
        d = pull[doc_of] / (1 + np.exp(-z))
        g = np.bincount(flat_f, d[word_of], BUCKETS) / len(y) + 1e-5 * model.weights
        past += g * g
        model.weights -= RATE * g / np.sqrt(past)
        gb = float(d.sum()) / len(y)
        past_bias += gb * gb
        model.bias -= 0.1 * gb / np.sqrt(past_bias)
    return calibrated(model, texts, y)


def calibrated(model: SentenceModel, texts: list[bytes], y: np.ndarray) -> SentenceModel:
    """Sets the shift so that as few training rows as possible fall on the wrong side of 0.5, rows of each label weighing the same."""
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    s = np.clip(model.scores(raw, offsets), 1e-12, 1 - 1e-12)
    odds = np.log(s) - np.log1p(-s)
    order = np.argsort(odds, kind="stable")
    o, t = odds[order], y[order]
    # With the bar above the k lowest, the wrong ones are the toxic below and twice the share of the clean above it.
    wrong = np.concatenate(([0], np.cumsum(t))) / y.sum() + 4 * ((1 - t).sum() - np.concatenate(([0], np.cumsum(1 - t)))) / (len(y) - y.sum())
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    bar = o[0] - 1 if k == 0 else o[-1] + 1 if k == len(o) else (o[k - 1] + o[k]) / 2
    model.shift = -float(bar)
    return model


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> SentenceModel:
    return train(*labelled(docs, labels, "toxic", 5, 0))


def score_toxicity(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts get the score of a text without words.

    Repeated rows each get a row, equal texts equal scores; very long texts are hashed in parts; columns beside doc_id and text are not read, so their
    names may be any; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(*flat(b.column(1))))], ["doc_id", "score"])

    return docs.select("doc_id", utf8().alias("t")).mapInArrow(run, "doc_id long, score double")


def toxic_spans(docs: DataFrame, model: SentenceModel, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score): the sentences that by themselves reach the score `least`, as byte spans of the text's UTF-8. Null and empty texts have none; else as score_toxicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in blocks(offsets):
                part, at = lowered(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                z, first, starts = model.logits(part, at)
                if model.share is not None:
                    z = np.full(len(starts), np.log(model.share + 1e-12) - np.log1p(1e-12 - model.share))
                p = 1 / (1 + np.exp(-(z + model.shift)))
                hit = np.flatnonzero(p >= least)
                row = np.searchsorted(first, hit, "right") - 1
                ends = np.append(starts, len(part))[hit + 1]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i + r] for r in row], pa.int64()), pa.array(starts[hit] - at[row]), pa.array(ends - at[row]), pa.array(p[hit])], ["doc_id", "start", "end", "score"])

    return docs.select("doc_id", utf8().alias("t")).mapInArrow(run, "doc_id long, start long, end long, score double")


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
