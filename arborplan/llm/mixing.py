"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import hashlib
import heapq
import re
from fractions import Fraction
from math import gcd, lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, cut, documents, n_words, row_hash, unboxed

SEED = 20240
#: Each source is dealt into so many shards, which get quotas of blocks of their own.
SHARDS = 1024
EPOCHS = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a block, whatever the input.
BLOCK = 64


def weights(sources: list[str | None]) -> dict[str | None, int]:
    """By code point, null last: 1, 2, 3, 1, 2, 3, ..."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: i % 3 + 1 for i, s in enumerate(ordered)}


def targets(sizes: dict, weight: dict, epochs: int = EPOCHS) -> dict:
    """Shares of all sizes by weight. No target is above epochs x its source's size; what is over goes to the others by weight, until none is above."""
    total, held, free = Fraction(sum(sizes.values())), {}, set(sizes)
    while free:
        left, w = total - sum(held.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > epochs * sizes[s]}
        if not over:
            return {s: held.get(s, left * weight[s] / w) for s in sizes}
        held |= {s: Fraction(epochs * sizes[s]) for s in over}
        free -= over
    return held


def sainte_lague(votes: dict, seats: int, most: dict | None = None) -> dict:
    """Seats by the highest quotients votes / (2 n + 1). `most` bounds a party's seats; ties go to the smaller key (null last)."""
    votes = {k: Fraction(v) for k, v in votes.items() if v > 0}
    cap = {k: (most or {}).get(k, seats) for k in votes}
    seats = min(seats, sum(cap.values()))
    if not votes or seats <= 0:
        return {k: 0 for k in votes}
    scale = lcm(*(v.denominator for v in votes.values()))
    votes = {k: int(v * scale) for k, v in votes.items()}

    def dealt(up: int, down: int) -> dict:
        """Seats by the divisor up / down: quotients rounded to the nearest whole number."""
        return {k: min(cap[k], (2 * v * down + up) // (2 * up)) for k, v in votes.items()}

    # Divisors are sought between 0, which gives too many seats, and one that gives none; the last seats are dealt one by one.
    down = 1 << 64
    low, high = 0, (2 * max(votes.values()) + 1) * down
    while high - low > 1 and seats - sum((won := dealt(high, down)).values()) > len(votes):
        middle = (low + high) // 2
        low, high = (middle, high) if sum(dealt(middle, down).values()) > seats else (low, middle)
    won = dealt(high, down)
    order = lambda k: (k is None, k)
    heap = [(Fraction(-votes[k], 2 * won[k] + 1), order(k), k) for k in votes if won[k] < cap[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(won.values())):
        _, o, k = heapq.heappop(heap)
        won[k] += 1
        if won[k] < cap[k]:
            heapq.heappush(heap, (Fraction(-votes[k], 2 * won[k] + 1), o, k))
    return won


def steps(seed: int, source: str | None, shard: int, n: int) -> tuple[int, int]:
    """(step, first) of a shard's seeded order of its n blocks: block b has the place (step x b + first) mod n, which no two share."""
    if n < 2:
        return 1, 0
    own = int.from_bytes(hashlib.blake2b(repr((seed, source, shard)).encode(), digest_size=16).digest(), "little")
    step = own % n
    while gcd(step, n) != 1:
        step = (step + 1) % n
    return step, (own >> 64) % n


def planned(sums: list, seed: int, block: int) -> list[tuple]:
    """From the sizes of every source's shards (source, shard, s): what each is to give, a row for each shard."""
    sizes: dict = {}
    for r in sums:
        sizes[r.source] = sizes.get(r.source, 0) + r.s
    want = targets(sizes, weights(list(sizes)))
    seats = sainte_lague(want, sum(sizes.values()) // block, {s: EPOCHS * n // block for s, n in sizes.items()})
    out = []
    for source in sizes:
        own = {r.shard: r.s for r in sums if r.source == source}
        quota = sainte_lague(own, seats.get(source, 0), {k: EPOCHS * n // block for k, n in own.items()})
        for k, n in own.items():
            passes, rest = divmod(quota.get(k, 0) * block, max(n, 1))
            out.append((source, k, n, sizes[source], float(want[source]), passes, rest, *steps(seed, source, k, n // block)))
    return out


_PLAN = "p_source string, p_shard int, shard_size long, source_size long, target double, passes long, rest long, step long, first long"


def mix_rows(rows: DataFrame, seed: int, shards: int, block: int, store: bool) -> DataFrame:
    """rows (source, size, key long, tie long and others) with source_size, target, shard, passes (how often a row is taken whole) and parts (what is taken of it once more: pairs of word numbers)."""
    rows = rows.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    rows = cut(rows) if store else rows
    plan = planned(rows.groupBy("source", "shard").agg(F.sum("size").alias("s")).collect(), seed, block)
    table = rows.sparkSession.createDataFrame(plan, _PLAN)
    out = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")))
    run = Window.partitionBy("source", "shard").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("end", F.sum("size").over(run)).withColumn("start", F.col("end") - F.col("size"))
    div = lambda a, b: F.call_function("div", a, b)
    size = F.lit(block).cast("long")
    whole, full, extra = div(F.col("shard_size"), size), div(F.col("rest"), size), F.col("rest") % size

    def taken(b: Column) -> Column:
        """Of block b the first so many words: all, some or none. The words behind the last whole block count as a last place."""
        place = F.when(b < whole, (F.col("step") * b + F.col("first")) % F.greatest(whole, F.lit(1))).otherwise(whole)
        upto = b * size + F.when(place < full, size).when(place == full, extra).otherwise(F.lit(0))
        return F.struct((F.greatest(b * size, F.col("start")) - F.col("start")).alias("a"), (F.least(upto, F.col("end")) - F.col("start")).alias("z"))

    blocks = F.sequence(div(F.col("start"), size), div(F.col("end") - 1, size))
    parts = F.filter(F.transform(blocks, taken), lambda p: p["a"] < p["z"])
    return out.withColumn("parts", F.when((F.col("size") > 0) & (F.col("rest") > 0), parts).otherwise(F.array().cast("array<struct<a:bigint,z:bigint>>")))


def mix_sources(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """Each document with size, source_size, target (its source's) and taken, the words that the mix takes of it.

    Size is the number of words [^\x20\x09-\x0D]+ (null and empty texts: 0). A source's blocks of equal length are apportioned to
    its shards; in a shard the documents stand in a seeded order, end to end, and as many blocks as its quota says are chosen by a seeded order of
    them. A quota over the shard's length takes the whole shard again, at most three times. Null is a source of its own; null doc_ids are dealt as -1; repeated
    rows are documents of their own; very long texts are counted whole; ties are told apart by the text, so reruns agree; columns beside doc_id, text and
    source are not read; an empty table, or one without a word, takes nothing. What reaches the driver is a number for each source and shard, not for each document.
    """
    rows = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "h")).withColumn("tie", F.col("h"))
    out = mix_rows(rows, seed, shards, block, store=True)
    some = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["z"] - p["a"])
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + some).cast("long").alias("taken"), "shard", "h")


def chosen_words(text: pd.Series, parts: pd.Series) -> pd.Series:
    """The words of the text with these numbers, each part as it stands in the text."""

    def one(t: str, own) -> str:
        out, wanted, at = [], [(int(p["a"]), int(p["z"])) for p in own], None
        spans = iter(wanted)
        a, z = next(spans, (-1, -1))
        for i, m in enumerate(WORD.finditer(t)):
            if i == a:
                at = m.start()
            if i == z - 1 and at is not None:
                out.append(t[at : m.end()])
                at = None
                a, z = next(spans, (-1, -1))
        return "\n".join(out)

    return pd.Series([one(t, p) for t, p in zip(text, parts, strict=True)], dtype=object)


def mixed(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken whole, and one with the chosen words for a part. Blocks that touch are one piece of text; others are put together by line feeds.

    Columns stay, whatever their names; n_chars, if there, follows the text. Repeated rows keep their own values: they are told apart by a hash of all columns. Null and
    empty texts have no words and are never taken; an empty table gives no rows; very long texts are cut in one pass over their words.
    """
    names = docs.columns
    rows = boxed(docs, "doc_id", "source", "text")
    rows = rows.select("row", F.col("k1").alias("source"), n_words("k2").alias("size"), F.xxhash64(F.lit(seed), F.coalesce("k0", F.lit(-1)), F.xxhash64(F.coalesce("k2", F.lit("")))).alias("key"), row_hash(rows).alias("tie"))
    taken = mix_rows(rows, seed, shards, block, store=False).where((F.col("passes") > 0) & (F.col("size") > 0) | (F.size("parts") > 0))
    text = f"c{names.index('text')}"
    none = F.array().cast("array<struct<a:bigint,z:bigint>>")
    times = F.concat(F.array_repeat(F.lit(None).cast("array<struct<a:bigint,z:bigint>>"), F.col("passes").cast("int")), F.when(F.size("parts") > 0, F.array("parts")).otherwise(F.array().cast("array<array<struct<a:bigint,z:bigint>>>")))
    each = taken.select("row", F.explode(times).alias("part"))
    cut_out = F.pandas_udf(chosen_words, "string")(F.when(F.col("part").isNull(), F.lit("")).otherwise(F.col(f"row.{text}")), F.coalesce("part", none))
    each = each.withColumn("cut", cut_out)
    own = F.col("row").withField(text, F.when(F.col("part").isNull(), F.col(f"row.{text}")).otherwise(F.col("cut")))
    if "n_chars" in names:
        own = own.withField(f"c{names.index('n_chars')}", F.char_length(F.when(F.col("part").isNull(), F.col(f"row.{text}")).otherwise(F.col("cut"))).cast("long"))
    return unboxed(each.select(own.alias("row")), names)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("h")
