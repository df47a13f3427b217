"""Removal of repeated byte strings (of 400 bytes, or another window) by column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

0. Texts that are there more than once repeat as a whole; from here on each different text counts once.
1. Anchors. Several windows can be asked for at once: the construction is that of the shortest, its segments go on for the bytes that
   the longest needs, and common prefixes tell them all. Of each (shortest) window the least (by hash) of its GRAM-byte strings is its anchor, the leftmost of equal ones. Equal
   windows have equal anchors at equal places, so only windows with a common anchor need to be compared. A run of windows
   with the same anchor is a segment: the windows' bytes, and what the longest window needs besides, up to the text's end.
2. Segments that are equal as a whole repeat in all their windows. The different segments of an anchor make the collection.
3. Segments are aligned at the anchor. What stands from the anchor on is sorted once; then each round puts one symbol of every segment
   before it, deals the segments stably by symbol (that is the column of the Burrows-Wheeler transform), and carries the common
   prefixes of neighbours over as one more than the least between them. Suffixes of other columns cannot be equal windows,
   so each column is merged with itself only. Symbols, transform, order and prefixes go through sequential files.
4. A string is repeated if its common prefix with a neighbour reaches its length.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, boxed, cut, documents, flat, lean, scratch, unboxed, utf8

WINDOW = 400
GRAM = 152
#: For passages of over 50 words, which may have fewer bytes than WINDOW: a window that one of 51 words of four letters and a space still holds.
PASSAGE = 250
PASSAGE_GRAM = 100
#: Windows of a text that are looked at together, which bounds memory for very long texts.
CHUNK = 1 << 19
#: Segments that one construction takes; an anchor with more different segments than HEAVY is split by its windows' digests.
COLLECTION = 16384
HEAVY = 8192
#: Texts that are wanted by their keys are looked for in so many cells of hashes first; the broadcast table has no more rows than that.
KEY_CELLS = 1 << 20


def key_of(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def anchored(raw: np.ndarray, window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of one text, in parts: anchor hashes, first windows, numbers of windows, and how far the anchor is from the first window."""
    span = window - gram + 1
    for base in range(0, len(raw) - window + 1, chunk):
        part = raw[base : base + chunk + window - 1]
        at = np.arange(len(part) - gram + 1)
        g = Rolling(part).slices(at, at + gram)
        v = (g >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
        n = len(part) - window + 1
        size = -(-len(v) // span) * span
        full = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        full[: len(v)] = v
        grid = full.reshape(-1, span)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(after[:n], before[span - 1 : span - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        yield g[anchor[first]], first + base, np.diff(np.append(first, n)), anchor[first] - first


def text_key(t: str = "t") -> Column:
    return F.unhex(F.substring(F.sha2(t, 256), 1, 32))


def cell(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_CELLS)).cast("int")


_SEGMENTS = "anchor long, digest long, key binary, starts array<int>, n int, off int, len int"


def segments(docs: DataFrame, windows: tuple[int, ...] = (WINDOW,), gram: int = GRAM) -> DataFrame:
    """The segments of every text (t binary), by text key. A segment that recurs in a text is one row with all its starts; copies in a batch come once."""
    window, most = min(windows), max(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column(0))
            rows: list[tuple] = []
            known: set[bytes] = set()
            for r in range(b.num_rows):
                own = raw[offsets[r] : offsets[r + 1]]
                if len(own) < window:
                    continue
                data = own.tobytes()
                key, found = key_of(data), {}
                if key in known:
                    continue
                known.add(key)
                for anchors, first, n, off in anchored(own, window, gram):
                    for a, s, k, o in zip(anchors.view(np.int64).tolist(), first.tolist(), n.tolist(), off.tolist(), strict=True):
                        d = int.from_bytes(hashlib.blake2b(data[s : s + k + most - 1], digest_size=8).digest(), "little", signed=True)
                        if (a, d) in found:
                            found[a, d][0].append(s)
                        else:
                            found[a, d] = ([s], k, o)
                rows += [(a, d, key, s, k, o, min(k + most - 1, len(data) - s[0])) for (a, d), (s, k, o) in found.items()]
                if len(rows) > 20000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _SEGMENTS.split(", ")])

    return docs.select("t").mapInArrow(run, _SEGMENTS)


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by anchor, digest and key those whose anchor another one has, or that recur in their text; copies' rows once. One batch is held."""
    last: pa.RecordBatch | None = None
    joined = False
    for b in batches:
        if not b.num_rows:
            continue
        if last is not None:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        anchor, digest = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        key = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, 16)
        fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1]) | (key[1:] != key[:-1]).any(1)))
        first = np.flatnonzero(fresh)
        own, recurs = anchor[first], np.diff(np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset :][: b.num_rows + 1])[first] > 1
        keep = recurs.copy()
        same = own[1:] == own[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= joined
        if len(out := first[:-1][keep[:-1]]):
            yield b.take(pa.array(out))
        # The last one's place among its neighbours is known when the next batch is there.
        last, joined = b.slice(int(first[-1]), 1), bool(keep[-1])
    if last is not None and joined:
        yield last


def repeated_windows(groups: np.ndarray, texts: list[bytes], off: np.ndarray, n: np.ndarray, windows: tuple[int, ...] = (WINDOW,)) -> list[list[np.ndarray]]:
    """For each window length and each segment at which of its n places stands a string of that length that another segment of its group has too.

    groups: ascending. off: places before the anchor. The column-wise construction; its files are in a folder that goes at the end.
    """
    window = max(windows)
    m = len(texts)
    tails = [t[o:] for t, o in zip(texts, off.tolist(), strict=True)]
    length = np.array([len(t) for t in tails])
    grid = np.zeros((m, window), np.uint8)
    for i, t in enumerate(tails):
        grid[i, : len(t)] = np.frombuffer(t, np.uint8)
    # Stable sorts, the least significant key first; a cut tail comes before what goes on where it ends.
    order = np.argsort(length, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(grid[order]).view(f"S{window}").ravel(), kind="stable")]
    order = order[np.argsort(groups[order], kind="stable")]
    same = grid[order[1:]] == grid[order[:-1]]
    prefix = np.where(same.all(1), window, same.argmin(1))
    prefix = np.minimum(prefix, np.minimum(length[order[1:]], length[order[:-1]]))
    prefix = np.concatenate(([0], np.where(groups[order[1:]] == groups[order[:-1]], prefix, 0))).astype(np.int32)
    marks = [[np.zeros(k, bool) for k in n.tolist()] for _ in windows]
    hits: list[tuple[list, list]] = [([], []) for _ in windows]

    def note(o: int) -> None:
        for w, (hit_seg, hit_at) in zip(windows, hits, strict=True):
            far = np.flatnonzero(prefix >= w)
            if len(far):
                both = np.unique(np.concatenate((order[far], order[far - 1])))
                both = both[off[both] - o < n[both]]
                hit_seg.append(both)
                hit_at.append(off[both] - o)

    note(0)
    rounds = int(off.max(initial=0))
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        path = lambda name: os.path.join(folder, name)
        columns = np.zeros((rounds, m), np.uint8)
        for i, (t, o) in enumerate(zip(texts, off.tolist(), strict=True)):
            columns[:o, i] = np.frombuffer(t, np.uint8, o)[::-1]
        columns.tofile(path("symbols"))
        del columns
        order.astype(np.int64).tofile(path("order"))
        prefix.tofile(path("prefix"))
        with open(path("symbols"), "rb") as symbols, open(path("transform"), "wb") as transform:
            for o in range(1, rounds + 1):
                old, common = np.fromfile(path("order"), np.int64), np.fromfile(path("prefix"), np.int32)
                symbol = np.fromfile(symbols, np.uint8, m)[old]
                symbol.tofile(transform)
                on = np.flatnonzero(off[old] >= o)
                if len(on) < 2:
                    break
                dealt = on[np.argsort(groups[old[on]] * 256 + symbol[on], kind="stable")]
                order = old[dealt]
                a, b = dealt[:-1], dealt[1:]
                joined = (groups[order[1:]] == groups[order[:-1]]) & (symbol[a] == symbol[b])
                prefix = np.zeros(len(order), np.int32)
                if joined.any():
                    # The least common prefix after place a up to place b.
                    x, y = a[joined] + 1, b[joined] + 1
                    ends = np.append(common, 0)
                    pairs = np.empty(2 * len(x), np.int64)
                    pairs[::2], pairs[1::2] = x, y
                    prefix[1:][joined] = np.minimum.reduceat(ends, pairs)[::2] + 1
                order.tofile(path("order"))
                prefix.tofile(path("prefix"))
                note(o)
    for own, (hit_seg, hit_at) in zip(marks, hits, strict=True):
        if hit_seg:
            for i, w in zip(np.concatenate(hit_seg).tolist(), np.concatenate(hit_at).tolist(), strict=True):
                own[i][w] = True
    return marks


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2].tolist(), edge[1::2].tolist()


_FOUND = "anchor long, digest long, which int, first array<int>, last array<int>"


def _collections(windows: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor: whole anchors together until a collection is full."""
        rows: list[tuple] = []

        def done(part: list[tuple]) -> pa.RecordBatch:
            names: dict[int, int] = {}
            groups = np.array([names.setdefault(r[0], len(names)) for r in part], np.int64)
            off, n = (np.array([r[k] for r in part], np.int64) for k in (2, 3))
            marks = repeated_windows(groups, [r[4] for r in part], off, n, windows)
            out = [(r[0], r[1], k, *_runs(x)) for k, own in enumerate(marks) for r, x in zip(part, own, strict=True) if x.any()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _FOUND.split(", ")])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if len(rows) >= COLLECTION and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield done(rows)

    return run


def _window_digests(windows: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, d, n, t in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                for k, w in enumerate(windows):
                    each = [hashlib.blake2b(t[i : i + w], digest_size=16).digest() for i in range(min(n, len(t) - w + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([a] * len(each), pa.int64()), pa.array([d] * len(each), pa.int64()), pa.array([k] * len(each), pa.int32()), pa.array(range(len(each)), pa.int32()), pa.array(each, pa.binary())], ["anchor", "digest", "which", "i", "w"])

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts wanted segments out of their texts."""
    for b in batches:
        for i in range(b.num_rows):
            text, want = b.column(0)[i].as_buffer().to_pybytes(), b.column(1)[i].as_py()
            numbers = [pa.array([w[c] for w in want], k) for c, k in (("anchor", pa.int64()), ("digest", pa.int64()), ("off", pa.int32()), ("n", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([text[w["start"] : w["start"] + w["len"]] for w in want], pa.binary())], ["anchor", "digest", "off", "n", "seg"])


def repeated_spans(docs: DataFrame, windows: tuple[int, ...] = (WINDOW,), gram: int = GRAM) -> DataFrame:
    """(key, spans0, spans1, ...): for each different text with repeats, where strings of each window's length are repeated, as unsorted (first, last + 1) pairs of starts, null without any.

    docs: t binary, key. Copies of a text have one key; their windows all repeat.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    window = min(windows)
    with scratch(spark):
        long = docs.select("key", F.length("t").alias("n")).where(F.col("n") >= window)
        copies = cut(long.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where("k > 1").select("key", "n"))
        dealt = segments(docs, windows, gram).repartition(n, "anchor").sortWithinPartitions("anchor", "digest", "key")
        rows = cut(dealt.mapInArrow(_shared_anchors, _SEGMENTS))
        anchors = rows.groupBy("anchor").agg((F.min("digest") != F.max("digest")).alias("mixed"))
        kinds = rows.groupBy("anchor", "digest").agg(F.sum(F.size("starts")).alias("k"), F.first("n").alias("n"), F.first("off").alias("off"), F.first("len").alias("len"), F.min(F.struct("key", F.col("starts")[0].alias("start"))).alias("own"))
        kinds = cut(kinds.join(anchors, "anchor"))
        upto = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.least("n", F.col("len") - (w - 1)).alias("last")) for i, w in enumerate(windows)))).alias("w")
        whole = kinds.where("k > 1").select("anchor", "digest", upto).where("w.last > 0").select("anchor", "digest", "w.which", F.array(F.lit(0)).alias("first"), F.array("w.last").alias("last"))
        wanted = cut(kinds.where("mixed").groupBy("own.key").agg(F.collect_list(F.struct("anchor", "digest", "off", "n", "len", F.col("own.start").alias("start"))).alias("want")))
        cells = wanted.select(cell("key").alias("cell")).distinct()
        texts = docs.join(F.broadcast(cells), cell("key") == F.col("cell"), "left_semi").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
        cuts = texts.join(wanted, "key").select("t", "want").mapInArrow(lean(_cutter), "anchor long, digest long, off int, n int, seg binary")
        heavy = [r.anchor for r in kinds.where("mixed").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HEAVY).select("anchor").limit(1).collect()]
        if heavy:
            cuts = cut(cuts)
            sizes = cuts.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"))
            light = cuts.join(sizes.where(F.col("c") <= HEAVY).select("anchor"), "anchor", "left_semi")
            each = cuts.join(sizes.where(F.col("c") > HEAVY).select("anchor"), "anchor", "left_semi").mapInArrow(_window_digests(windows), "anchor long, digest long, which int, i int, w binary")
            each = cut(each)
            twice = each.groupBy("which", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("which", "w")
            more = each.join(twice, ["which", "w"]).groupBy("anchor", "digest", "which").agg(F.collect_list("i").alias("first")).select("anchor", "digest", "which", "first", F.transform("first", lambda i: i + 1).alias("last"))
        else:
            light, more = cuts, None
        built = light.repartition(n, "anchor").sortWithinPartitions("anchor", "digest").mapInArrow(lean(_collections(windows)), _FOUND)
        if more is not None:
            built = built.unionByName(more)
        single = kinds.where("mixed and k = 1").select("anchor", "digest")
        parts = whole.union(built.join(single, ["anchor", "digest"], "left_semi").select("anchor", "digest", "which", "first", "last"))
        hit = rows.select("anchor", "digest", "key", "starts").join(parts, ["anchor", "digest"]).join(copies, "key", "left_anti")
        spans = F.flatten(F.transform("starts", lambda s: F.zip_with("first", "last", lambda a, b: F.struct((s + a).alias("a"), (s + b).alias("b")))))
        none = F.array().cast("array<struct<a:int,b:int>>")
        each = [F.flatten(F.collect_list(F.when(F.col("which") == i, F.col("spans")))).alias(f"spans{i}") for i in range(len(windows))]
        found = hit.select("key", "which", spans.alias("spans")).groupBy("key").agg(*each)
        every = [F.when(F.col("n") >= w, F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - (w - 1)).alias("b")))).otherwise(none).alias(f"spans{i}") for i, w in enumerate(windows)]
        both = found.union(copies.select("key", *every))
        return cut(both.select("key", *(F.when(F.size(f"spans{i}") > 0, F.col(f"spans{i}")).alias(f"spans{i}") for i in range(len(windows)))), keep=True)


def merged(spans: list, window: int = WINDOW) -> list[tuple[int, int]]:
    """Byte runs that windows with these starts cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] - 1 + window) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spanned(rows: DataFrame, windows: tuple[int, ...] = (WINDOW,), gram: int = GRAM) -> DataFrame:
    """rows (any columns, t binary) with spans0, spans1, ..., one for each window; without repeats null. No other column may be named key, cell or like these.

    Texts without any repeats aren't shuffled: those with some are looked for by cells of their keys, in a broadcast table of at most KEY_CELLS numbers.
    """
    rows = rows.withColumn("key", text_key())
    found = repeated_spans(rows.select("key", "t"), windows, gram)
    cells = F.broadcast(found.select(cell("key").alias("cell")).distinct())
    there = cell("key") == F.col("cell")
    some = rows.join(cells, there, "left_semi").join(found.withColumnRenamed("key", "skey"), F.col("key") == F.col("skey"), "left").drop("skey", "key")
    none = rows.join(cells, there, "left_anti").drop("key")
    return some.unionByName(none, allowMissingColumns=True)


def with_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text, ...) as doc_id, t (the text's UTF-8, null: empty), spans, for all rows; other columns are not read.

    Every byte that a repeated window covers is in a span. Texts under the window's length have no spans; copies of a
    text have the same; repeated rows each give a row; very long texts are worked on in parts; an empty table gives no rows.
    """
    return spanned(docs.select("doc_id", utf8().alias("t")), (window,), gram).withColumnRenamed("spans0", "spans")


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, raw, spans, short in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            runs = merged(spans)
            rows.append((doc_id, len(raw), sum(y - x for x, y in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest(), sum(y - x for x, y in merged(short, PASSAGE))))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _DIGEST.split(", ")])


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> str:
    """What is left of a text: of a character that a run cuts, all stays, so that the rest is a text again."""
    out, at = [], 0
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:  # the run begins inside a character
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:  # it ends inside one
            b -= 1
        out.append(raw[at:a])
        at = max(at, b)
    return b"".join([*out, raw[at:]]).decode()


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs without the bytes that repeated windows cover; a document of which nothing is left goes.

    n_chars, if there is one, follows the text. Other columns stay, whatever their names; null texts, empty ones and those under the window's
    length stay as they are; of copies and repeated rows of a window's length or more nothing is left, so they all go (in the pipeline the stage before has brought
    them to one). Very long texts are worked on in parts. An empty table gives no rows.
    """
    names = docs.columns

    @F.udf("string", useArrow=True)
    def rest(raw: bytes | None, spans: list | None) -> str | None:
        return None if spans is None else whole_characters(bytes(raw), merged(spans, window))

    rows = spanned(boxed(docs, "text").select("row", utf8("k0").alias("t")), (window,), gram)
    left = F.when(F.col("spans0").isNull(), F.col(f"row.c{names.index('text')}")).otherwise(rest(F.when(F.col("spans0").isNotNull(), F.col("t")), "spans0"))
    out = rows.select("row", left.alias("left"), F.col("spans0").isNull().alias("same")).where(F.col("same") | (F.length("left") > 0))
    own = F.col("row").withField(f"c{names.index('text')}", F.col("left"))
    if "n_chars" in names:
        n = f"c{names.index('n_chars')}"
        own = own.withField(n, F.when(F.col("left").isNull(), F.col(f"row.{n}")).otherwise(F.char_length("left")).cast("long"))
    return unboxed(out.select(own.alias("row")), names)


def op3_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for 400 bytes, and n_passage: the bytes that repeated strings of PASSAGE bytes cover, which short passages have too."""
    rows = spanned(documents(spark, sf_dir).select("doc_id", utf8().alias("t")), (WINDOW, PASSAGE), PASSAGE_GRAM)
    return rows.select("doc_id", "t", "spans0", "spans1").mapInArrow(_digests, _DIGEST)
