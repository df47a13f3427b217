"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, so no sequence crosses documents."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, lean

MOST = 2048
END = 1
#: Chunks whose ids a worker keeps; the store starts anew beyond it.
KNOWN = 800_000

# White space other than blanks and line feeds: texts that have any are encoded whole.
_RARE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def parted(text: str) -> list[str] | None:
    """The text's chunks between single blanks; None if white space stands in runs, at an end, or is of a rare kind."""
    chunks = text.split(" ")
    if "\n" in text and ("\n\n" in text or "\n " in text or " \n" in text or text[0] == "\n" or text[-1] == "\n"):
        return None
    return None if "" in chunks or _RARE.search(text) else chunks


# Fixed value: how byte-level tokenizers of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_merges(path: str):
    """A quicker encoder with the tokenizer's own vocabulary, or None if its merges aren't numbered in their order.

    Where they are, merging by rank and by merge list are the same, and short chunks cost a tenth.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
    plain = model.get("type") == "BPE" and not model.get("dropout") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    if not plain or any(model["vocab"].get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
        return None
    back, added = shown_bytes(), {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, size


class Chunks:
    """Ids of texts by a byte-level BPE tokenizer, made chunk by chunk.

    Its pre-tokenizer begins a token at each single space before a non-space, whatever stands around, so a text without runs
    of white space is the chunks between its spaces, and a chunk's ids are the same wherever it stands. Other texts, and those that
    hold an added token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = same_merges(path)
        self.known: dict[str, bytes] = {}
        self.opening: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def short(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that begin with a space or stand alone. No token crosses from one into the next, so those with a space are encoded end to end and cut by their lengths."""
        if not self.quick or not chunks or chunks[0][:1] != " ":
            return self.whole(chunks)
        encode, size = self.quick
        ids = np.array(encode("".join(chunks)), "<u4")
        cuts = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(c.encode()) for c in chunks])) + 1
        data, at, out = ids.tobytes(), 0, []
        for cut_at in (cuts * 4).tolist():
            out.append(data[at:cut_at])
            at = cut_at
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if self.added and any(a in t for a in self.added) else parted(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known, self.opening = {}, {}
        unseen: set[str] = set()
        for s in split:
            if s:
                unseen.update(filterfalse(self.known.__contains__, islice(s, 1, None)))
        for store, prefix, new in ((self.opening, "", {s[0] for s in split if s} - self.opening.keys()), (self.known, " ", unseen)):
            new = list(new)
            for i in range(0, len(new), 1 << 16):
                part = new[i : i + (1 << 16)]
                store.update(zip(part, self.short([prefix + x for x in part]), strict=True))
        odd = iter(self.whole([t for t, s in zip(texts, split, strict=True) if s is None]))
        get = self.known.__getitem__
        return [next(odd) if s is None else self.opening[s[0]] + b"".join(map(get, islice(s, 1, None))) for s in split]


def lengths(n: int, most: int = MOST) -> list[int]:
    """n as a sum of powers of two up to `most`, largest first."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, part int, place long"


def pieces(docs: DataFrame, tokenizer_path: str, most: int = MOST, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document's ids; with_ids adds the ids. A null or empty text is its end id alone."""
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part, seen = Chunks(tokenizer_path), TaskContext.get().partitionId(), [0] * most.bit_length()
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                slab = b.slice(at, 1000)
                rows = []
                for doc_id, ids in zip(slab.column(0).to_pylist(), chunks.ids(slab.column(1).to_pylist()), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for size in lengths(n, most):
                        bucket = size.bit_length() - 1
                        own = ids[4 * start : 4 * (start + size)]
                        rows.append((doc_id, start, size, zlib.crc32(own), n, bucket, part, seen[bucket]) + ((np.frombuffer(own, "<u4").astype(np.int64),) if with_ids else ()))
                        seen[bucket] += 1
                        start += size
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] + [pa.list_(pa.int64())] * with_ids
                names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run), _PIECES + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, most: int = MOST, with_ids: bool = False) -> DataFrame:
    """The pieces, numbered: bucket by bucket, each piece a sequence of its own whose length is a power of two, so nothing is padded.

    Pieces are stored once in the shared folder, so that their numbers stand even if an executor is lost. A row of counts
    for each input partition and bucket is broadcast. Repeated rows are documents of their own; an empty table gives no rows.
    """
    made = cut(pieces(docs, tokenizer_path, most, with_ids))
    counts = made.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    base = sums.withColumnRenamed("bucket", "b2").join(F.broadcast(sums.select("bucket")), F.col("b2") < F.col("bucket"), "right").groupBy("bucket").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("base"))
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(base), "bucket").select("bucket", "part", (F.col("base") + F.col("before")).alias("first"))
    out = made.join(F.broadcast(first), ["bucket", "part"])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *["ids"] * with_ids)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())
