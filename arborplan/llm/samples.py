"""Bounded samples of labelled documents, the only rows that the classifiers learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Documents of each label that a classifier learns from, and the longest text among them in bytes.
PER_LABEL = 1200
LONGEST = 32768


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "UTF-8")), F.lit(mod)) == rest


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, per_label: int = PER_LABEL, longest: int = LONGEST) -> tuple[list[bytes], np.ndarray]:
    """Up to per_label whole texts of each label, by a hash of their ids, and their labels.

    Held-out ids, null labels and texts over `longest` bytes are left out; an id with several labels counts with its largest,
    one with several rows with one of them. The driver gets at most 2 x per_label x longest bytes.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", mod, rest)).groupBy("doc_id").agg(F.max(label).alias("y"))
    text = docs.select("doc_id", utf8().alias("t")).where((F.length("t") <= longest) & ~held_out("doc_id", mod, rest))
    found = text.select("doc_id").join(ids, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = None
    for y in (0, 1):
        part = found.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    keys = docs.sparkSession.createDataFrame([(r.doc_id, int(r.y)) for r in chosen.collect()], "c_id long, y int")
    rows = text.join(F.broadcast(keys), F.col("doc_id") == F.col("c_id")).groupBy("c_id", "y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: r.c_id)
    return [bytes(r.t) for r in rows], np.array([r.y for r in rows], np.float64)
