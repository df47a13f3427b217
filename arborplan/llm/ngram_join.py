"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, boxed, cut, documents, flat, lean, lowered, mix, row_hash, scratch, unboxed, utf8, word_hashes, words
from .components import components

SHINGLE = 4
#: Two sets link when 100 x their intersection is at least PERCENT x their union.
PERCENT = 85
#: Shingle counts are kept in 2**CELL_BITS cells, whatever the input: 4 MB that each worker gets. They only order the
#: shingles; any order gives the same links.
CELL_BITS = 20
SLICES = 64
#: Ranges of hashes; the suffix filter compares whether sets have odd or even counts of shingles in them.
RANGES = 1024
#: The same folded to fewer ranges, for rows of which there are many.
FOLDED = 256
#: Texts that candidates name are looked for in so many cells of hashes first; the broadcast table has no more rows than that.
TEXT_CELLS = 1 << 20
#: Bytes of a set's name.
NAME = 12
#: Components with more sets than this on a token's list are paired as a whole with the rest of it.
LIGHT = 32
ORDERS = 3
#: About so many sets of a component are compared at once with as many others.
BLOCK = 128
#: Columns of the matrix whose products count shared shingles.
COLUMNS = 1 << 14


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; with fewer words the whole sequence is the only one; none without words."""
    for i, j in blocks(offsets):
        part, at = lowered(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        start, end, first = words(part, at)
        own = word_hashes(part, start, end)
        n = len(own)
        with np.errstate(over="ignore"):
            full = own[: max(0, n - size + 1)].copy()
            for k in range(1, size):
                full = mix(full * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(full)])
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= size:
                yield np.unique(full[a : b - size + 1])
            elif b > a:
                h = own[a : a + 1].copy()
                with np.errstate(over="ignore"):
                    for k in range(a + 1, b):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[k : k + 1])
                    yield mix(h + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def node_of(hashes: np.ndarray) -> bytes:
    """Names a set of shingles; equal sets share it."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=NAME).digest()


_SETS = "doc_id long, text_hash long, n long, node binary, signature array<long>, slice int, cells binary"


def _summaries(batches: Iterator[pa.RecordBatch], size: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    names = [x.split()[0] for x in _SETS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    for b in batches:
        n, node, sign, seen = [], [], [], []
        for h in shingle_hashes(*flat(b.column(2)), size):
            n.append(len(h))
            node.append(node_of(h) if len(h) else None)
            odd = np.bincount((h & np.uint64(RANGES - 1)).astype(np.intp), minlength=RANGES) & 1
            sign.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            seen.append(h)
        if seen:
            counts += np.bincount((np.concatenate(seen) >> np.uint64(64 - CELL_BITS)).astype(np.intp), minlength=len(counts)).astype(np.uint32)
        none = [None] * b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, k) for v, k in zip((n, node, sign, none, none), kinds[2:], strict=True))], names)
    if counts.any():
        none = [None] * SLICES
        parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((none, none, none, none, none, range(SLICES), parts), kinds, strict=True)], names)


def _summed(cells: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << CELL_BITS) // SLICES, np.int64)
    for c in cells["cells"]:
        total += np.frombuffer(zlib.decompress(c), "<u4")
    return pd.DataFrame({"slice": [int(cells["slice"].iloc[0])], "cells": [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]})


def rarity(sets: DataFrame) -> np.ndarray:
    """How many sets' shingles fall in each cell, over all documents. Tasks' counts are added in two steps, so no task meets them all."""
    rows = sets.where("slice is not null").select("slice", "cells").withColumn("salt", F.spark_partition_id() % 32)
    half = rows.groupBy("slice", "salt").applyInPandas(_summed_packed, "slice int, cells binary")
    out = np.zeros(1 << CELL_BITS, np.uint32)
    step = len(out) // SLICES
    for r in half.groupBy("slice").applyInPandas(_summed, "slice int, cells binary").collect():
        out[r.slice * step : (r.slice + 1) * step] = np.frombuffer(bytes(r.cells), "<u4")
    return out


def _summed_packed(cells: pd.DataFrame) -> pd.DataFrame:
    out = _summed(cells)
    out["cells"] = [zlib.compress(c, 1) for c in out["cells"]]
    return out


def needed(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """The least intersection at which sets of these sizes link."""
    return F.call_function("div", (a + b).cast("long") * percent + (99 + percent), F.lit(100 + percent).cast("long"))


def prefix_rows(docs: DataFrame, counts: np.ndarray, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(token, node, n, pos): the rarest shingles of each set, as many as a partner's set must share one of."""
    held = docs.sparkSession.sparkContext.broadcast(counts)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for b in batches:
            raw, offsets = flat(b.column(0))
            known: set[bytes] = set()  # copies in a batch give their rows once
            for i, j in blocks(offsets, 1 << 21):
                tokens, nodes, sizes, places = [], [], [], []
                for h in shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size):
                    if not len(h) or (node := node_of(h)) in known:
                        continue
                    known.add(node)
                    k = len(h) - -(-percent * len(h) // 100) + 1
                    seen = order[(h >> np.uint64(64 - CELL_BITS)).astype(np.intp)]
                    tokens.append(h[np.lexsort((h, seen))[:k]])
                    nodes.append((node, k))
                    sizes.append(np.full(k, len(h)))
                    places.append(np.arange(k))
                if nodes:
                    names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(nodes)), [k for _, k in nodes]), pa.array([x for x, _ in nodes], pa.binary())).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), names, pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))], ["token", "node", "n", "pos"])

    return docs.select(utf8().alias("t")).mapInArrow(lean(run), "token long, node binary, n int, pos int")


def _shared(percent: int = PERCENT):
    """Of rows sorted by token, n, pos and node those that may make a pair on their token's list; repeated (token, node) rows once.

    The first shingle that two linking sets share stands in the smaller one so early that it could link with an equal set from there
    on; call that row fit. So a row stays if it is fit and the next row's set isn't too large for it, or if the last fit row before it isn't too
    small. What is held is one batch, one row of the batch before, and the size of that token's last fit row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        low = 0  # the size of the last fit row before `last` on its list, 0 without one
        for b in batches:
            if not b.num_rows:
                continue
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            token = b.column(0).to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, NAME)
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (raw[1:] != raw[:-1]).any(1)))
            first = np.flatnonzero(fresh)
            token, n, pos = token[first], b.column(2).to_numpy()[first].astype(np.int64), b.column(3).to_numpy()[first]
            at = np.arange(len(first))
            fit = pos <= n - -(-2 * percent * n // (100 + percent))
            begins = np.maximum.accumulate(np.where(np.concatenate(([True], token[1:] != token[:-1])), at, 0))
            before = np.concatenate(([-1], np.maximum.accumulate(np.where(fit, at, -1))[:-1]))
            smaller = np.where(before >= begins, n[before], np.where(begins == 0, low, 0))
            keep = smaller * 100 >= n * percent
            keep[:-1] |= fit[:-1] & (token[1:] == token[:-1]) & (n[1:] * percent <= n[:-1] * 100)
            if len(out := first[:-1][keep[:-1]]):
                yield b.take(pa.array(out))
            last, low, on = b.slice(int(first[-1]), 1), int(smaller[-1]), bool(keep[-1])
        if last is not None and on:
            yield last

    return run


def _linked(batches: Iterator[pa.RecordBatch], size: int = SHINGLE, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those that link."""
    for b in batches:
        raw_a, at_a = flat(b.column(2))
        raw_b, at_b = flat(b.column(3))
        keep, held, held_set = [], None, None
        for r, y in enumerate(shingle_hashes(raw_b, at_b, size)):
            own = b.column(0)[r].as_py()
            if own != held:
                part = raw_a[at_a[r] : at_a[r + 1]]
                held, held_set = own, next(shingle_hashes(part, np.array([0, len(part)]), size))
            x = held_set
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                keep.append(r)
        yield b.select([0, 1]).take(pa.array(keep, pa.int64()))


def _met(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x shares with each of y."""
    found, at = np.unique(np.concatenate((*x, *y)), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(h) for h in (*x, *y)])
    # A column is a shingle that at least two sets have.
    often = np.bincount(at, minlength=len(found)) > 1
    column = np.cumsum(often) - 1
    row, at = row[often[at]], column[at[often[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for low in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(at, (low, low + COLUMNS))
        has = np.zeros((len(x) + len(y), min(COLUMNS, int(often.sum()) - low)), np.float32)
        has[row[i:j], at[i:j] - low] = 1
        out += (has[: len(x)] @ has[len(x) :].T).astype(np.int64)
    return out


def _meetings(pairs: bool, size: int = SHINGLE, percent: int = PERCENT):
    """For rows (root, i, j, side, node, w, t) sorted by the first four, where side 0 is compared with side 1, or with itself if i = j:
    (a, b) of the sets that link, or (node, far), the sum of w over the sets that a set links with here."""

    def met(same: bool, nodes: tuple[list, list], weights: tuple[list, list], sets: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        right = 0 if same else 1
        if not nodes[0] or not nodes[right]:
            return
        shared = _met(sets[0], sets[right])
        n, m = (np.array([len(h) for h in sets[k]]) for k in (0, right))
        link = 100 * shared >= percent * (n[:, None] + m[None, :] - shared)
        if same:
            np.fill_diagonal(link, False)
        x, y = (pa.array(nodes[k], pa.binary()) for k in (0, right))
        if pairs:
            a, b = np.nonzero(np.triu(link) if same else link)
            yield pa.RecordBatch.from_arrays([x.take(pa.array(a)), y.take(pa.array(b))], ["a", "b"])
            return
        yield pa.RecordBatch.from_arrays([x, pa.array(link @ np.array(weights[right], np.int64))], ["node", "far"])
        if not same:
            yield pa.RecordBatch.from_arrays([y, pa.array(link.T @ np.array(weights[0], np.int64))], ["node", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, None
        for batch in batches:
            *columns, _ = (c.to_pylist() if k < 6 else None for k, c in enumerate(batch.columns))
            for root, i, j, side, node, w, h in zip(*columns, shingle_hashes(*flat(batch.column(6)), size), strict=True):
                if (root, i, j) != held:
                    if kept:
                        yield from met(held[1] == held[2], *kept)
                    held, kept = (root, i, j), (([], []), ([], []), ([], []))
                for own, value in zip(kept, (node, w, h), strict=True):
                    own[side].append(value)
        if kept:
            yield from met(held[1] == held[2], *kept)

    return run


class Join:
    """The steps of one join. Stored in the shared folder: the sets' summaries and the tokens that sets share."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> None:
        spark = docs.sparkSession
        self.size, self.percent = size, percent
        rows = docs.select("doc_id", "text")
        self.sets = cut(rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), utf8().alias("t")).mapInArrow(lean(lambda batches: _summaries(batches, size)), _SETS), keep=True)
        self.rows = self.sets.where("slice is null").select("doc_id", "text_hash", "n", "node")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        prefix = prefix_rows(rows, rarity(self.sets), size, percent).repartition(n, "token").sortWithinPartitions("token", "n", "pos", "node")
        self.shared = cut(prefix.mapInArrow(_shared(percent), "token long, node binary, n int, pos int"))
        #: One row for each set, with a row of docs that has it.
        named = self.sets.where("node is not null")
        self.nodes = cut(named.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("own"), F.first("n").alias("n"), F.first("signature").alias("signature")))
        self.docs = rows

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, t) of nodes (node): the text of one row that has the set.

        Texts are looked for by cells of their hashes first, in a broadcast table of at most TEXT_CELLS numbers, so that few of the others are shuffled.
        """
        own = cut(nodes.join(self.nodes, "node").select("node", "own"))
        cells = own.select(F.pmod("own.text_hash", F.lit(TEXT_CELLS)).cast("int").alias("cell")).distinct()
        there = self.docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("own"), utf8().alias("t"))
        there = there.join(F.broadcast(cells), F.pmod("own.text_hash", F.lit(TEXT_CELLS)).cast("int") == F.col("cell"), "left_semi")
        # One key for both steps, so that repeated rows are brought together where the join needs them. A null id equals a null id in it.
        return there.dropDuplicates(["own"]).join(own.hint("merge"), "own").select("node", "t")

    def suffix_filter(self, x: str, y: str, na: str, nb: str, ranges: int = RANGES) -> Column:
        """Each shingle in one set alone changes one range's parity, so ranges of unlike parity bound the difference from below."""
        unlike = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, ranges // 64)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
        return unlike <= F.col(na) + F.col(nb) - 2 * needed(F.col(na), F.col(nb), self.percent)

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs that the suffix filter leaves."""
        signs = self.nodes.select("node", "n", "signature")
        both = pairs.distinct().join(signs.toDF("a", "na", "sa"), "a").join(signs.toDF("b", "nb", "sb"), "b")
        return both.where(self.suffix_filter("sa", "sb", "na", "nb")).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of stored, distinct pairs those that link; each is looked at once."""
        with scratch(self.docs.sparkSession):
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            texts = cut(self.texts(ends))
            ta, tb = texts.toDF("a", "ta"), texts.toDF("b", "tb")
            both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
            size, percent = self.size, self.percent
            return cut(both.mapInArrow(lean(lambda batches: _linked(batches, size, percent)), "a binary, b binary"), keep=True)

    def may_link(self, na: str, pa_: str, nb: str, pb: str) -> Column:
        """Length filter, and the positional one: what can still be shared from this token on."""
        a, b = F.col(na), F.col(nb)
        return (F.least(a, b) * 100 >= F.greatest(a, b) * self.percent) & (F.least(a - F.col(pa_), b - F.col(pb)) >= needed(a, b, self.percent))

    def stars(self) -> DataFrame:
        """Each set of a token's list with the list's first one and with the one before it in one of ORDERS seeded orders, where the filters allow it.

        Few pairs that join most of what belongs together; which token has which order only bounds a set's partners.
        """
        rows = self.shared.withColumn("o", F.xxhash64(F.pmod("token", F.lit(ORDERS)), "node"))
        by_size, seeded = Window.partitionBy("token").orderBy("n", "node"), Window.partitionBy("token").orderBy("o", "node")
        rows = rows.select("*", *(f(c).over(w).alias(f"{k}_{c}") for k, f, w in (("first", F.first, by_size), ("prev", F.lag, seeded)) for c in ("node", "n", "pos")))
        found = None
        for k in ("first", "prev"):
            part = rows.where((F.col(f"{k}_node") != F.col("node")) & self.may_link(f"{k}_n", f"{k}_pos", "n", "pos")).select(F.least(f"{k}_node", "node").alias("a"), F.greatest(f"{k}_node", "node").alias("b"))
            found = part if found is None else found.union(part)
        return found

    def rest(self, roots: DataFrame) -> DataFrame:
        """All pairs of sets on a token's list that are in different components, and that the filters leave.

        A list of one component makes no pairs. A large component on a list is first joined as one row, so its
        sets are not paired with each other even to be thrown away.
        """
        rows = self.shared.join(roots, "node", "left").select("token", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
        rows = cut(rows)
        lists = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("mass"))
        mixed = lists.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
        lists = lists.join(mixed, "token", "left_semi")
        folds = FOLDED // 64
        folded = F.array(*(reduce(Column.bitwiseXOR, (F.col("signature")[i] for i in range(k, RANGES // 64, folds))) for k in range(folds)))
        rows = cut(rows.join(lists, ["token", "root"]).join(self.nodes.select("node", folded.alias("signature")), "node"))
        names = ("token", "node", "n", "pos", "root", "mass", "s")
        a, b = (rows.select(*names[:-1], "signature").toDF(*(c if c == "token" else f"{c}_{k}" for c in names)) for k in "xy")
        passes = self.may_link("n_x", "pos_x", "n_y", "pos_y") & self.suffix_filter("s_x", "s_y", "n_x", "n_y", FOLDED)
        differ = F.col("root_x") != F.col("root_y")
        light = a.where(F.col("mass_x") <= LIGHT).join(b.where(F.col("mass_y") <= LIGHT).withColumnRenamed("token", "t"), (F.col("token") == F.col("t")) & (F.col("node_x") < F.col("node_y")) & differ & passes)
        heavy = lists.where(F.col("mass") > LIGHT).select("token", F.col("root").alias("heavy"))
        # On such lists a pair is made at the first of them that it shares: there both rows know the lists before.
        w = Window.partitionBy("node").orderBy("pos", "token").rowsBetween(Window.unboundedPreceding, -1)
        hot = rows.join(heavy.select("token").distinct(), "token", "left_semi").withColumn("before", F.collect_list("token").over(w))
        a, b = (hot.select(*names[:-1], "signature", "before").toDF(*(c if c == "token" else f"{c}_{k}" for c in (*names, "before"))) for k in "xy")
        met = heavy.join(b, "token").where((F.col("heavy") != F.col("root_y")) & ((F.col("mass_y") <= LIGHT) | (F.col("heavy") < F.col("root_y"))))
        new = ~F.arrays_overlap("before_x", "before_y")
        far = a.withColumnRenamed("token", "t").join(met, (F.col("t") == F.col("token")) & (F.col("root_x") == F.col("heavy")) & passes & new)
        found = light.select("node_x", "node_y").union(far.select("node_x", "node_y"))
        return found.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))

    def roots(self) -> DataFrame:
        """(node, root) of the sets that link with another set."""
        with scratch(self.docs.sparkSession):
            star = cut(self.filtered(self.stars()))
            links = self.verified(star)
            first = components(links)
            more = self.verified(cut(self.filtered(self.rest(first)).join(star, ["a", "b"], "left_anti")))
            return cut(first if more.isEmpty() else components(links.union(more)), keep=True)

    def meetings(self, roots: DataFrame) -> DataFrame:
        """Every two sets of a component in some (root, i, j), once. No link leaves a component, so these hold all links.

        A component is dealt into blocks by hash, and two blocks meet at a time: no task must hold more than two.
        """
        weight = self.rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("w"))
        k = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
        own = roots.join(k, "root").join(weight, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        rows = own.join(self.texts(roots.select("node")), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        rows = rows.select("root", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "w", "t")
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "side")

    def links(self, roots: DataFrame) -> DataFrame:
        """(a, b), once each: all pairs of different sets that link."""
        return self.meetings(roots).mapInArrow(_meetings(True, self.size, self.percent), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def degrees(self, roots: DataFrame) -> DataFrame:
        """(node, far): with how many rows of other sets each row of a set links. Counted where blocks meet, so links make no rows."""
        return self.meetings(roots).mapInArrow(_meetings(False, self.size, self.percent), "node binary, far long").groupBy("node").agg(F.sum("far").alias("far"))


def ngram_components(docs: DataFrame, with_links: bool = False, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_hash; rows that a chain of links joins share the smallest doc_id.

    Shingles have `size` words; sets link from `percent` per cent of their union on. Documents with equal shingle sets are one set from the
    start, so copies cost no pairs. Sets on a token's list are first linked to its first set; then all pairs that the filters leave between
    different components are verified. A document without words (null and empty texts) is linked with nothing. Null doc_ids take part; a
    component of them alone has a null id. Ties go to the smaller id. Very long texts are hashed in parts.
    with_links adds n_links, the number of other rows that a row links with: every two sets of a component are compared, and
    copies count as often as they are there. Components alone need only some of the links. Repeated rows each give a row; columns beside
    doc_id and text are not read, so their names may be any; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        join = Join(docs, size, percent)
        roots = join.roots()
        far = cut(join.degrees(roots), keep=True) if with_links else None
        roots = cut(roots, keep=True)
        rows = join.rows.join(roots, "node", "left").select("doc_id", "text_hash", "n", "node", F.coalesce("root", "node").alias("root"))
        low = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("low"))
        out = rows.join(low, "root", "left")
        own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low"))
        named = [F.col("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("text_hash")]
        if far is None:
            return out.select(*named)
        copies = rows.where("node is not null").groupBy("node").agg((F.count(F.lit(1)) - 1).alias("copies"))
        out = out.join(copies, "node", "left").join(far, "node", "left")
        return out.select(*named, (F.coalesce("copies", F.lit(0)) + F.coalesce("far", F.lit(0))).alias("n_links"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (a null id only if there is no other).

    Documents without words (null and empty texts) each stay, but repeated rows of one are one; of repeated rows that differ in other columns the one with the
    least hash of all columns stays. Columns stay as they are, whatever their names. An empty table gives no rows; very long texts are read whole.
    """
    rows = ngram_components(docs, size=size, percent=percent)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    group = F.when(F.col("n_shingles") > 0, F.concat(F.lit("c"), F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("n"), F.col("text_hash"))))).otherwise(F.concat(F.lit("e"), F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.lit("."), F.col("text_hash")))
    kept = rows.groupBy(group.alias("g")).agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("h")).distinct()
    there = boxed(docs, "doc_id", "text").select("row", "k0", F.xxhash64(F.coalesce("k1", F.lit(""))).alias("k1"))
    found = there.join(kept, F.col("k0").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("h")), "left_semi")
    return unboxed(found.groupBy("k0", "k1").agg(F.min_by("row", row_hash(there)).alias("row")), docs.columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_ngram_join's columns and the number of each document's links; the SQL of that query has no column for it."""
    return ngram_components(documents(spark, sf_dir), with_links=True).select("doc_id", "n_shingles", "component_id", "n_links")
