"""Shared pieces: byte words, shingle hashes, scratch tables, fold marks, grouped streams, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.scratch import Scratch

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


MAPPED = 1 << 20  # bytes from which a worker's arrays are pages of their own, which go back as soon as they are freed


def release() -> None:
    """Gives freed memory of this process back to the system, where the C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A function of batches after whose task the worker gives back what it has freed; workers, and what they hold, outlive tasks."""

    @wraps(run)
    def wrapped(batches):
        if option := getattr(ctypes.CDLL(None), "mallopt", None):
            option(-3, MAPPED)  # M_MMAP_THRESHOLD, which else grows with the arrays freed
        yield from run(batches)
        release()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash per run of k words, in order; a shorter text is one shingle, an empty one has none."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        x = U64(n)
        out = np.full(1, x, U64)
        for w in h:
            out = mix64(out * _P + w)
        return out
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out = mix64(out * _P + h[j : n - k + 1 + j])
    return out


def fold(column: str, k: int):
    """crc32 of the id as text, modulo k; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a sorted stream of batches; a run may span batches."""
    held: list[pa.Table] = []
    last: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        values = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held and tuple(v[0] for v in values) != last:
            yield pa.concat_tables(held)
            held = []
        change = np.zeros(t.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        start = 0
        for c in (np.flatnonzero(change) + 1).tolist():
            yield pa.concat_tables([*held, t.slice(start, c - start)])
            held, start = [], c
        held.append(t.slice(start))
        last = tuple(v[-1] for v in values)
    if held:
        yield pa.concat_tables(held)


def binary_rows(column) -> list[bytes]:
    return column.to_pylist()


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of the nodes in edges (u, v): alternating large and small stars.

    component is the smallest node reachable. Hubs are met by partial aggregation; in the joins a hub's edges meet its
    one row. Each round is written to the scratch folder.
    """
    spark = scratch.spark

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    e = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    count = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    step, state = 0, count(e)
    while state[0]:
        two = both(e)
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        nxt = scratch.table(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now, e = count(nxt), nxt
        if now == state:
            break
        state = now
    # a fixed point is a forest of stars: every u hangs on its component's smallest node
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
