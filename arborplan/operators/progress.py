"""Metrics of a running copy, from its events (job, seq, bytes, elapsed_ns): rates, stalls, fields of a progress line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# A new sample each 300 ms; the old rate keeps 0.6 of its weight; a stall shows after 5 s; a line is drawn each 60 ms.
RESAMPLE_NS = 300_000_000
KEEP = 0.6
STALL_NS = 5_000_000_000
REDRAW_NS = 60_000_000


def running_bytes(items: DataFrame) -> DataFrame:
    """items (job, seq, written) with total, the bytes up to each; those of failed items stay counted."""
    return items.withColumn("total", F.sum("written").over(Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


class Meter:
    """Smoothed rate and stall clock of one job, event by event. The state is five numbers."""

    def __init__(self, last_at: int = 0, last_bytes: int = 0, rate: float = 0.0, seen: int = 0, moved_at: int = 0) -> None:
        self.state = (last_at, last_bytes, rate, seen, moved_at)

    def observe(self, done: int, elapsed: int) -> tuple[float, int]:
        """Rate in bytes a second, and nanoseconds since bytes last moved."""
        last_at, last_bytes, rate, seen, moved_at = self.state
        if done > seen:
            seen, moved_at = done, elapsed
        if elapsed > last_at and (rate == 0 or elapsed - last_at >= RESAMPLE_NS):
            now = (done - last_bytes) / ((elapsed - last_at) / 1e9)
            rate = now if rate == 0 else KEEP * rate + (1 - KEEP) * now
            last_at, last_bytes = elapsed, done
        self.state = (last_at, last_bytes, rate, seen, moved_at)
        return rate, elapsed - moved_at


def rates(events: DataFrame) -> DataFrame:
    """events with rate and stalled_ns. Each sample depends on the last, so a job's events are folded in order; what is held is one batch of them, not the job."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, meter = None, Meter()
        first = True
        for b in batches:
            got = []
            for j, done, elapsed in zip(b["job"], b["bytes"], b["elapsed_ns"], strict=True):
                if first or j != job:
                    job, meter, first = j, Meter(), False
                got.append(meter.observe(int(done), int(elapsed)))
            yield b.assign(rate=[g[0] for g in got], stalled_ns=[g[1] for g in got])

    own = events.select("job", "seq", "bytes", "elapsed_ns")
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, "job").sortWithinPartitions("job", "seq").mapInPandas(fold, "job string, seq long, bytes long, elapsed_ns long, rate double, stalled_ns long")


def stall_clock(events: DataFrame) -> DataFrame:
    """events with stalled_ns and shown: time since bytes were last above all before, by window functions alone."""
    w = Window.partitionBy("job").orderBy("seq")
    before = F.coalesce(F.max("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = events.withColumn("__m", F.when(F.col("bytes") > before, F.col("elapsed_ns")))
    last = F.coalesce(F.last("__m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    out = moved.withColumn("stalled_ns", F.col("elapsed_ns") - last).drop("__m")
    return out.withColumn("shown", F.col("stalled_ns") >= STALL_NS)


def phases(items: DataFrame) -> DataFrame:
    """Two events for each item of a plan (job, seq): announced with done = its place, completed with done = place + 1, also on failure."""
    both = F.array(F.struct(F.lit("announce").alias("phase"), F.col("seq").alias("done")), F.struct(F.lit("complete").alias("phase"), (F.col("seq") + 1).alias("done")))
    return items.select("job", "seq", F.explode(both).alias("e")).select("job", "seq", "e.phase", "e.done")


def drawn(events: DataFrame) -> DataFrame:
    """The events of each job that a display draws: at least REDRAW_NS after the last drawn one, and the final one."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, last = None, None
        for b in batches:
            keep = []
            for j, at, final in zip(b["job"], b["elapsed_ns"], b["final"], strict=True):
                if j != job:
                    job, last = j, None
                show = bool(final) or last is None or at - last >= REDRAW_NS
                last = at if show else last
                keep.append(show)
            yield b[keep][["job", "seq", "elapsed_ns"]]

    own = events.select("job", "seq", "elapsed_ns", F.lead("seq").over(Window.partitionBy("job").orderBy("seq")).isNull().alias("final"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, "job").sortWithinPartitions("job", "seq").mapInPandas(fold, "job string, seq long, elapsed_ns long")


def whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def line_fields(done: Column, total: Column, done_bytes: Column, elapsed_ns: Column) -> list[Column]:
    """percent, bar of 30 cells, and bytes a second since the start."""
    cells = F.when(total > 0, whole(done * 30, F.greatest(total, F.lit(1)))).otherwise(F.lit(0)).cast("int")
    percent = F.when(total > 0, whole(done * 100, F.greatest(total, F.lit(1)))).otherwise(F.lit(0))
    bar = F.concat(F.repeat(F.lit("█"), cells), F.repeat(F.lit("░"), F.lit(30) - cells))
    rate = F.when(elapsed_ns > 0, done_bytes / (elapsed_ns / 1e9)).otherwise(F.lit(0.0))
    return [percent.cast("long").alias("percent"), bar.alias("bar"), rate.alias("rate")]


def report(results: DataFrame, elapsed_ns: int = 0) -> DataFrame:
    """One row for a copy's results (bytes, error): items, failed, bytes, and the closing line: bytes, duration, average rate."""
    sums = results.agg(F.count(F.lit(1)).alias("items"), F.count("error").alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    spent = F.lit(elapsed_ns).cast("long")
    rate = F.when(spent > 0, F.col("bytes") / (spent / 1e9)).otherwise(F.lit(0.0))
    return sums.withColumn("text", F.concat(text.human_bytes(F.col("bytes")), F.lit(" in "), text.human_duration(spent), F.lit("  ·  "), text.human_rate(rate), F.lit(" average")))


def failure_lines(results: DataFrame) -> DataFrame:
    """(seq, line) of the items that failed, in plan order: what was to be copied and why it wasn't."""
    return results.where("error is not null").select("seq", F.concat("src", F.lit(": "), "error").alias("line")).orderBy("seq")
