"""Amounts as people read them. Tenths are rounded as C's printf rounds them: to the nearest value of the exact binary number, halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["kB", "MB", "GB", "TB", "PB"]


def tenths(x: Column) -> Column:
    """x (not negative) with one decimal, rounded by the exact value of the binary number, halves to even.

    The fraction times 2**59 is a whole number, so its tenths and what is left of them are found without error.
    """
    d = x.cast("double")
    whole = F.floor(d)
    scaled = ((d - whole) * F.lit(float(1 << 59))).cast("long") * 10
    tenth, rest, half = F.shiftright(scaled, 59), scaled.bitwiseAND(F.lit((1 << 59) - 1)), F.lit(1 << 58)
    up = (rest > half) | ((rest == half) & (tenth % 2 == 1))
    all_tenths = whole * 10 + tenth + up.cast("long")
    return F.concat(F.call_function("div", all_tenths, F.lit(10).cast("long")).cast("string"), F.lit("."), (all_tenths % 10).cast("string"))


def human_bytes(n: Column) -> Column:
    """Under 1000 whole bytes, then thousands with one decimal; a rounded 1000.0 isn't carried on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS):
        low = 1000 ** (i + 1)
        out = F.when(n >= low, F.concat(tenths(n.cast("double") / F.lit(float(low))), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_rate(bps: Column) -> Column:
    return F.when(bps <= 0, F.lit("— MB/s")).otherwise(F.concat(tenths(bps / 1e6), F.lit(" MB/s")))


def human_duration(ns: Column) -> Column:
    """Tenths of a second under one second; else whole seconds, minutes and seconds, or hours and minutes cut down."""
    s = F.floor((ns + 500_000_000) / F.lit(1_000_000_000)).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(ns < 1_000_000_000, F.concat(tenths(ns / 1e9), F.lit("s")))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat((s / 60).cast("long").cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat((s / 3600).cast("long").cast("string"), F.lit("h"), two(((s % 3600) / 60).cast("long")), F.lit("m")))
    )


def eta_ns(done: Column, total: Column, elapsed_ns: Column) -> Column:
    """Nanoseconds still to go by whole division; null before three items, at the end, or under a second."""
    eta = F.call_function("div", elapsed_ns, F.greatest(done, F.lit(1))) * (total - done)
    return F.when((done >= 3) & (total > done) & (elapsed_ns > 0) & (eta >= 1_000_000_000), eta)


def stall_message(after_ns: Column, rounded: bool) -> Column:
    """`no data for ...`: in copies rounded to a second from one second on."""
    s = F.when(after_ns >= 1_000_000_000, F.floor((after_ns + 500_000_000) / F.lit(1_000_000_000)).cast("string")) if rounded else F.lit(None)
    return F.concat(F.lit("no data for "), F.coalesce(s, (after_ns / 1e9).cast("string")), F.lit("s"))
