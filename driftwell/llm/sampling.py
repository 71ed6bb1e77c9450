"""Labelled rows for fitting, all or bounded, repeatable samples; those stay in a scratch table, no text is brought to the driver."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPARE = 2.0  # times the rows asked for that the hash threshold lets through before the exact cut


def share_of(h):
    """A 64-bit hash as a number from 0 to below 1."""
    return F.shiftrightunsigned(h, 11) / float(1 << 53)


def learning_rows(rows: DataFrame, per_class: int, scratch: Scratch, name: str, *keys: str) -> DataFrame:
    """(class, text): at most ``per_class`` distinct rows of each non-null class, those of the lowest hash of keys and text.

    rows: class, text (binary), keys. Equal rows are one row; every row keeps its own text and class, whatever ids
    repeat. Two scans: one estimates how many distinct rows a class has, one writes those below a threshold of the
    hash, about twice as many as asked for; the exact cut needs only their hashes. No class is left out.
    """
    h = rows.where("class is not null").withColumn("h", F.xxhash64(*keys, "text"))
    sizes = h.groupBy("class").agg((F.lit(SPARE * per_class) / F.approx_count_distinct("h", 0.02)).alias("part"))
    few = h.join(F.broadcast(sizes), "class").where(share_of(F.col("h")) < F.col("part"))  # a row for each class
    few = scratch.table(few.groupBy("class", "h").agg(F.first("text").alias("text")), name)
    found: dict = {}
    for r in few.select("class", "h").collect():  # about SPARE * per_class longs for each class
        found.setdefault(r["class"], []).append((r["h"] % (1 << 64), r["h"]))
    cuts = [(c, x[1]) for c, hs in sorted(found.items()) for x in sorted(hs)[:per_class]]
    kind = few.schema["class"].dataType.simpleString()
    chosen = few.sparkSession.createDataFrame(cuts, f"class {kind}, h long")
    return few.join(F.broadcast(chosen), ["class", "h"]).select("class", "text")


def labelled_rows(docs: DataFrame, marks: DataFrame, per_class: int, scratch: Scratch, name: str) -> DataFrame:
    """(class, text) of at most ``per_class`` labelled documents of each class.

    docs: doc_id, text (binary); marks: doc_id, class, distinct. Ids are chosen from the marks first, so that only a
    bounded list meets the documents; an id with several classes is learned with each, a text under a repeated id
    with the labels of that id. Ids without a document give no row.
    """
    known = marks.where("class is not null and doc_id is not null").withColumn("id_hash", F.xxhash64("doc_id"))
    sizes = known.groupBy("class").agg((F.lit(SPARE * per_class) / F.count("*")).alias("part"))
    ids = known.join(F.broadcast(sizes), "class").where(share_of(F.col("id_hash")) < F.col("part")).select("doc_id", "class")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # SPARE * per_class ids a class
    return learning_rows(rows, per_class, scratch, name, "doc_id")


def all_labelled_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(class, text) of all labelled documents; docs: doc_id, text; marks: doc_id, class, distinct.

    Where labels cover a part of the documents, most others are kept out of the join by one bit for each hash of an id,
    eight bits or more for each mark, in rows of 4 KB; the join itself is by id.
    """
    known = marks.where("class is not null and doc_id is not null")
    bits = 1 << max(15, (8 * known.count()).bit_length())
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    row, bit = (spot / (1 << 15)).cast("long"), spot % (1 << 15)
    maps = known.groupBy(row.alias("row")).agg(F.bitmap_construct_agg(bit).alias("map"))
    byte = F.conv(F.hex(F.expr("substring(map, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = docs.select("doc_id", "text", row.alias("row"), bit.alias("bit")).join(F.broadcast(maps), "row").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0)
    return met.join(known.hint("merge"), "doc_id").select("class", "text")  # marks grow with the input: no size is broadcast


def prior_shift(marks: DataFrame, used: list[int] | bytes) -> float:
    """What a logit fitted on a sample with the 0/1 classes ``used`` lacks to the shares of all marks (doc_id, class)."""
    n = {r["class"]: r["count"] for r in marks.groupBy("class").count().collect()}
    s1, s0 = sum(used), len(used) - sum(used)
    if not (s1 and s0 and n.get(1) and n.get(0)):
        return 0.0
    return log(n[1] / n[0]) - log(s1 / s0)
