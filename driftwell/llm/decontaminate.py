"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by size into classes of at most u = 1, 2, 4, 8, ... shingles. For a class, every text is cut
into blocks of u shingles, and each two adjacent blocks are a domain, so a passage of item size lies whole in one
domain of bounded size however long the text is. A containment of 0.8 is then a Jaccard similarity of at least 0.19
in that domain, and one equal minhash of ``HASHES`` makes a candidate: at that least similarity it is missed once in
700,000. Candidates are verified by the item's shingles in the whole text.

The items are the query set: they are worked through in blocks of bounded shingle count, each sent to the executors
and held against all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, free_name, lean, shingle_hashes, word_hashes, words_of
from .minhash_dedup import multipliers, shingle_set, signatures

HASHES, SEED, LEAST = 64, 0xBE7C, 1
BLOCK_SHINGLES, BLOCK_ITEMS = 1_000_000, 20_000  # bounds of one block of items


class Index:
    """Minhashes of one block of items by size class, and their shingle sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.a, self.b = multipliers(HASHES, SEED)
        size = np.array([len(s) for s in sets])
        self.classes = []
        u = LEAST
        while len(size) and u < 2 * size.max():
            items = np.flatnonzero((size <= u) & ((size > u // 2) | (u == LEAST)))
            if len(items):
                sig = signatures([sets[i] for i in items], self.a, self.b)
                order = np.argsort(sig, axis=0, kind="stable")
                low = np.zeros((HASHES, 1 << 16), bool)
                for h in range(HASHES):
                    low[h, sig[:, h] & 0xFFFF] = True
                self.classes.append((u, low, np.take_along_axis(sig, order, 0), items[order]))
            u *= 2

    def candidates(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs; x: shingle hashes of all texts, each in its order; sizes at least 1."""
        found: set[tuple[int, int]] = set()
        for u, low, sig, items in self.classes:
            n = -(-sizes // u)
            owner = np.repeat(np.arange(len(sizes)), n)
            at = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * u
            joined = np.append(owner[1:] == owner[:-1], False)
            for h in range(HASHES):
                m = (np.minimum.reduceat(x * self.a[h] + self.b[h], at) >> U64(32)).astype(np.uint32)
                m = np.where(joined, np.minimum(m, np.append(m[1:], m[-1])), m)
                for d in np.flatnonzero(low[h, m & 0xFFFF]):
                    left, right = np.searchsorted(sig[:, h], m[d], "left"), np.searchsorted(sig[:, h], m[d], "right")
                    found.update((int(owner[d]), int(i)) for i in items[left:right, h])
        return found


def _matches(batches, shared, k: int, percent: int, text: str):
    """Each batch with (row, item, shared, size) of the verified matches of a batch's texts."""
    _, index = shared.value
    for batch in batches:
        at, out = 0, []
        while at < batch.num_rows:
            start, lists, size = at, [], 0
            while at < batch.num_rows and size < 500_000:
                lists.append(shingle_hashes(word_hashes(words_of(batch.column(text)[at].as_py())), k))
                size += len(lists[-1])
                at += 1
            full = [i for i, s in enumerate(lists) if len(s)]
            if not full:
                continue
            sizes = np.array([len(lists[i]) for i in full])
            held: dict[int, np.ndarray] = {}
            for t, item in sorted(index.candidates(np.concatenate([lists[i] for i in full]), np.cumsum(sizes) - sizes, sizes)):
                if t not in held:
                    held = {t: np.unique(lists[full[t]])}
                n = len(np.intersect1d(index.sets[item], held[t], assume_unique=True))
                if 100 * n >= percent * len(index.sets[item]):
                    out.append((start + full[t], item, n, len(index.sets[item])))
        yield batch, out


def _search(shared, k: int, percent: int):
    @lean
    def run(batches):
        ids = shared.value[0]
        for batch, out in _matches(batches, shared, k, percent, "text"):
            if out:
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array([o[0] for o in out])),
                        "item_id": pa.array([ids[o[1]] for o in out], pa.int64()),
                        "n_shared": pa.array([o[2] for o in out], pa.int64()),
                        "n_item": pa.array([o[3] for o in out], pa.int64()),
                        "containment": pa.array([o[2] / o[3] for o in out], pa.float64()),
                    }
                )

    return run


def _clean(shared, k: int, percent: int, text: str):
    @lean
    def run(batches):
        for batch, out in _matches(batches, shared, k, percent, text):
            keep = np.ones(batch.num_rows, bool)
            keep[[o[0] for o in out]] = False
            yield batch.filter(pa.array(keep)).drop_columns([text])

    return run


def item_blocks(items: DataFrame, k: int):
    """(ids, sets) of consecutive items within the bounds of a block."""
    ids, sets, size = [], [], 0
    for r in items.toLocalIterator():
        s = shingle_set(bytes(r["text"]) if r["text"] is not None else None, k)
        if r["item_id"] is None or not len(s):
            continue
        if ids and (size + len(s) > BLOCK_SHINGLES or len(ids) >= BLOCK_ITEMS):
            yield ids, sets
            ids, sets, size = [], [], 0
        ids.append(r["item_id"])
        sets.append(s)
        size += len(s)
    if ids:
        yield ids, sets


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and item with percent % or more of the item's distinct k-word shingles in the document.

    Columns: doc_id, item_id, n_shared, n_item, containment. A text under k words is one shingle of all its words, so a
    short item is found only as a whole short document. Null and empty texts and items match nothing, nor do items
    without an id; documents without one are reported with a null id. Repeated documents and items are all reported;
    other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    out = None
    for ids, sets in item_blocks(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")), k):
        part = d.mapInArrow(_search(spark.sparkContext.broadcast((ids, Index(sets))), k, percent), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def uncontaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no item; one pass over the texts for each block of items."""
    spark, name, out = docs.sparkSession, free_name(docs, "text_bytes"), docs
    for ids, sets in item_blocks(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")), k):
        shared = spark.sparkContext.broadcast((ids, Index(sets)))
        out = out.withColumn(name, F.col(text_col).cast("binary")).mapInArrow(_clean(shared, k, percent, name), docs.schema)
    return out
