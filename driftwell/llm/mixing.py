"""Mixing sources to target weights over fixed-length blocks of words.

The words of a source, document after document, are cut into blocks of ``block`` words. A source with target t takes
n slots of the mix, in proportion; the slots are dealt over output shards by drawing each shard's counts from the
multinomial distribution given the sources' totals (a hypergeometric split of each half of the shards, down to one
shard, so any shard's counts and first slot numbers follow from its own path and need no other shard). Slot j of a
source is its block pi_e(j mod b), with b blocks and e = j // b: pi_e is a Feistel permutation keyed by source and
round e, so a round takes each block once. Slots and blocks then meet by block number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, lean, mix64

WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], times: int = 3) -> list[float]:
    """Shares of the total by weight, none above ``times`` its size; what is above is shared anew by weight."""
    out, left, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while left:
        total = sum(weights[i] for i in left)
        over = {i for i in left if rest * weights[i] / total > times * sizes[i]}
        if not over:
            for i in left:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = float(times * sizes[i])
        left -= over
        rest -= sum(out[i] for i in sorted(over))
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n), at x: six Feistel rounds on an even number of bits, walked until in range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out, todo = U64((1 << half) - 1), x.astype(U64), np.arange(len(x))
    while len(todo):
        v = out[todo]
        left, right = v >> U64(half), v & mask
        for r in range(6):
            f = mix64(right + U64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64))
            left, right = right, left ^ (f & mask)
        out[todo] = (left << U64(half)) | right
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


def split_counts(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of a draw of ``take`` slots without replacement."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        other = rest - c
        if take <= 0 or c == 0:
            got = 0
        elif rest < 1_000_000_000:
            got = int(rng.hypergeometric(c, other, take)) if other else take
        else:  # beyond the library's range: the normal limit, within what is possible
            p = c / rest
            got = round(rng.normal(take * p, math.sqrt(take * p * (1 - p) * (rest - take) / (rest - 1))))
            got = min(max(got, take - other, 0), c, take)
        out[i] = got
        take -= got
        rest = other
    return out


def shard_counts(shard: int, shards: int, per_shard: int, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's slots by source, and the first of them in each source's numbering."""
    a, b, now, first = 0, shards, counts.copy(), np.zeros(len(counts), np.int64)
    while b - a > 1:
        mid = (a + b) // 2
        left = split_counts(now, (mid - a) * per_shard, np.random.default_rng([seed, a, b]))
        if shard < mid:
            b, now = mid, left
        else:
            a, now, first = mid, now - left, first + left
    return now, first


def _slots(shards: int, per_shard: int, counts: np.ndarray, blocks: np.ndarray, seed: int):
    @lean
    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                n, first = shard_counts(shard, shards, per_shard, counts, seed)
                source = np.repeat(np.arange(len(n)), n)
                j = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(source))
                turn, at = np.divmod(j, blocks[source])
                block = np.empty(len(j), np.int64)
                for s in np.flatnonzero(n):
                    own = source == s
                    for e in np.unique(turn[own]):
                        pick = own & (turn == e)
                        block[pick] = permuted(at[pick], int(blocks[s]), seed + 1_000_003 * int(s) + 7919 * int(e) + 1)
                slot = np.random.default_rng([seed, shard]).permutation(len(j))
                yield pa.record_batch({"shard": pa.array(np.full(len(j), shard)), "slot": pa.array(slot), "source_no": pa.array(source.astype(np.int32)), "block": pa.array(block)})

    return run


class Mix:
    """A drawn mix: ``documents`` (a row for each) and ``slots`` (shard, slot, source_no, block).

    The figures of all sources are held by the driver and sent to every task, so more than ``MOST_SOURCES`` of them
    raise ValueError. ``keep_texts`` puts the texts beside the rows' numbers in the scratch table, for ``blocks``.
    """

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, per_shard: int = 4096, times: int = 3, seed: int = 20, keep_texts: bool = False):
        self.spark, self.block, self.times = docs.sparkSession, block, times
        self.scratch = Scratch(self.spark, "mix")
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        self.keep_texts = keep_texts
        texts = [F.col(text_col).alias("text")] if keep_texts else []
        sized = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text_col).alias("mark"), *texts)
        self.sized = self.scratch.table(sized, "sized")
        sized = self.sized.drop("text")
        found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in found]
        goals = targets(sizes, [1 + i % 3 for i in range(len(sizes))], times)
        blocks = np.array([-(-s // block) for s in sizes], np.int64)
        counts = np.array([min(times * b, round(g * b / s)) if s else 0 for g, b, s in zip(goals, blocks.tolist(), sizes, strict=True)], np.int64)
        shards = max(1, -(-int(counts.sum()) // per_shard)) if len(counts) else 0
        self.slots = self.spark.range(0, shards).mapInArrow(_slots(shards, per_shard, counts, np.maximum(1, blocks), seed), "shard long, slot long, source_no int, block long")
        table = [(r["source"], i, r["size"], goals[i]) for i, r in enumerate(found)]
        names = self.spark.createDataFrame(table, "name string, source_no int, source_size long, target double")
        known = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")

        # a document's place among its source's words: sums within salted parts, then over the parts; the place follows
        # from ids and texts, not from how the table is laid out in files
        parts = max(1, math.isqrt(sum(r["n"] for r in found)))
        part = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(parts))
        inner = Window.partitionBy("source_no", "part").orderBy("doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, 0)
        salted = known.withColumn("part", part)
        placed = salted.withColumn("before", F.sum("size").over(inner) - F.col("size"))
        outer = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        heads = salted.groupBy("source_no", "part").agg(F.sum("size").alias("s")).withColumn("head", F.sum("s").over(outer) - F.col("s")).drop("s")
        self.placed = placed.join(heads, ["source_no", "part"]).withColumn("at", F.col("head") + F.col("before"))

    def pieces(self) -> DataFrame:
        """(row, doc_id, source_no, block, place, from, words): the runs of each document's words by block."""
        end = F.col("at") + F.col("size")
        p = self.placed.where("size > 0").select("row", "doc_id", "source_no", "at", end.alias("end"), F.explode(F.sequence(F.floor(F.col("at") / self.block), F.floor((end - 1) / self.block))).alias("block"))
        low = F.greatest(F.col("block") * self.block, "at")
        return p.select("row", "doc_id", "source_no", F.col("block").cast("long").alias("block"), low.alias("place"), (low - F.col("at")).alias("from"), (F.least((F.col("block") + 1) * self.block, "end") - low).alias("words"))

    def documents(self) -> DataFrame:
        taken = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        taken = self.pieces().select("row", "source_no", "block", "words").join(taken.hint("merge"), ["source_no", "block"])  # the plan takes the drawn slots for few rows
        taken = taken.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return self.placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def blocks(self) -> DataFrame:
        """The mix itself: (shard, slot, source_no, block, text), each block's words joined by blanks."""
        if not self.keep_texts:
            raise ValueError("blocks of words need keep_texts")
        words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
        cut = self.pieces().join(self.sized.select("row", "text"), "row")
        cut = cut.select("source_no", "block", "place", F.array_join(F.slice(words, (F.col("from") + 1).cast("int"), F.col("words").cast("int")), " ").alias("t"))
        text = cut.groupBy("source_no", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), " ").alias("text"))
        return self.slots.hint("merge").join(text, ["source_no", "block"])


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    Null texts have size 0 and are never taken. Documents of a null source are a source of their own, last. Repeated
    and null ids keep their rows. A source without words has target 0. Other columns are ignored; an empty table
    gives an empty result. Reruns draw the same mix. More than 100,000 sources raise ValueError.
    """
    return Mix(docs, **options).documents()
