"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``m`` small keys, each of ``r`` minhashes, are combined in pairs: table (i, j) has the key
(A_i, B_j) of 2r minhashes, so m * m tables cost only 2 * m * r minhashes. A pair that shares a table is a candidate;
candidates are confirmed on the full shingle sets. With m = 10 and r = 3, a pair at similarity 0.8 shares no table
with probability 0.0015, one at 0.85 with 0.0001.

Work is kept in proportion to the input:

* Documents with one shingle set are one node; copies never form pairs.
* A key of the first collection that only one node has cannot match in any table, so only nodes with a repeated key
  go on to the combined keys.
* In a table's bucket every node is compared with a few leaders only. What these stars join is one class; in the
  next round other leaders meet only nodes of other classes. Members of different classes that share a bucket after
  the last round are compared in blocks of bounded size, each pair in the first table it shares, so no pair within a
  bucket is left out and no list of all pairs is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, connected, groups, lean, mix64, shingle_hashes, word_hashes, words_of

ROWS, KEYS, SEED = 3, 10, 0x5EED
BLOCK, STAR_ROUNDS, LEADERS, MARKS = 256, 2, 4, 512


def multipliers(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), k))


def set_id(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))))


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash over each (non-empty) set, as 32 bits."""
    out = np.empty((len(sets), len(a)), np.uint32)
    if sets:
        x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        for i in range(len(a)):
            out[:, i] = np.minimum.reduceat(x * a[i] + b[i], starts) >> U64(32)
    return out


def half_keys(sig: np.ndarray, rows: int, keys: int) -> np.ndarray:
    """(n, 2 * keys) 64-bit keys of the two collections, tagged with their place."""
    s = sig.reshape(len(sig), 2 * keys, rows).astype(U64)
    out = np.broadcast_to(np.arange(1, 2 * keys + 1, dtype=U64) << U64(40), s.shape[:2]).copy()
    for j in range(rows):
        out = mix64(out * U64(0x100000001B3) + s[:, :, j])
    return out


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _sign(k: int, rows: int, keys: int):
    @lean
    def run(batches):
        a, b = multipliers(2 * rows * keys)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start = 0
            while start < len(texts):  # pieces of about a million shingles
                sets, size, at = [], 0, start
                while at < len(texts) and size < 1_000_000:
                    sets.append(shingle_set(texts[at].as_py(), k))
                    size += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, a, b))
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(start, at - start),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "node": pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                        "sig": pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    }
                )
                start = at

    return run


def _sets(k: int):
    @lean
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = [shingle_set(x.as_py(), k) for x in batch.column(0).slice(start, 500)]
                yield pa.record_batch({"node": pa.array([set_id(s) for s in sets], pa.int64()), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _first_keys(rows: int, keys: int):
    @lean
    def run(batches):
        for batch in batches:
            half = half_keys(_matrix(batch.column("sig"), 2 * rows * keys), rows, keys)[:, :keys]
            yield pa.record_batch({"key": pa.array(half.reshape(-1).view(np.int64)), "node": pa.array(np.repeat(batch.column("node").to_numpy(), keys))})

    return run


def _tensor_keys(rows: int, keys: int):
    @lean
    def run(batches):
        for batch in batches:
            second = half_keys(_matrix(batch.column("sig"), 2 * rows * keys), rows, keys)[:, keys:]
            lists = batch.column("first")
            n = np.diff(lists.offsets.to_numpy())
            first = lists.flatten().to_numpy().view(U64)
            owner = np.repeat(np.arange(batch.num_rows), n)
            for start in range(0, len(first), 20_000):
                o = owner[start : start + 20_000]
                key = mix64(first[start : start + 20_000, None] * U64(0x9E3779B97F4A7C15) ^ second[o])
                yield pa.record_batch({"bucket": pa.array(key.reshape(-1).view(np.int64)), "node": pa.array(np.repeat(batch.column("node").to_numpy()[o], keys))})

    return run


def _confirm(percent: int):
    @lean
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


@lean
def _marks(batches):
    """A longer signature of a set, one byte a hash, and the set cut to 32 bits, for nodes that need a finer look."""
    a, b = multipliers(MARKS, SEED + 1)
    for batch in batches:
        out, short = [], []
        for x in batch.column("set"):
            s = np.frombuffer(x.as_buffer(), U64)
            low = np.full(MARKS, 2**64 - 1, U64)
            for at in range(0, len(s), 2000):
                low = np.minimum(low, (s[at : at + 2000, None] * a + b).min(axis=0))
            out.append((low >> U64(32)).astype(np.uint8).tobytes())
            short.append((s >> U64(32)).astype(np.uint32).tobytes())
        yield pa.record_batch({"node": batch.column("node"), "mark": pa.array(out, pa.binary()), "short": pa.array(short, pa.binary())})


def _block_pairs(rows: int, keys: int, percent: int):
    """Pairs of different classes in a block pair of a first key, under the first such key that they share.

    Passed over are pairs whose minhashes agree less often than the threshold minus five standard errors, and pairs
    whose cut sets, which have no fewer elements in common than the sets, are not near enough.
    """
    width, level = 2 * rows * keys, percent / 100
    least, sure = (level - 5 * (level * (1 - level) / n) ** 0.5 for n in (width, MARKS))

    @lean
    def run(batches):
        for t in groups(batches, ["key", "lo", "hi"]):
            if t.num_rows < 2:
                continue
            key, lo, hi, block = t.column("key")[0].as_py(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), t.column("block").to_numpy()
            node, cls, sig = t.column("node").to_numpy(), t.column("class").to_numpy(), _matrix(t.column("sig"), width)
            mark = np.frombuffer(b"".join(t.column("mark").to_pylist()), np.uint8).reshape(-1, MARKS)
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            short = [np.frombuffer(x, np.uint32) for x in t.column("short").to_pylist()]
            half = half_keys(sig, rows, keys)
            first = half[:, :keys].view(np.int64)
            us, vs = [], []
            for x in left:
                ys = right[(cls[right] != cls[x]) & ((node[right] > node[x]) if lo == hi else True)]
                ys = ys[(sig[ys] == sig[x]).mean(axis=1) >= least]
                ys = ys[first[x, (first[ys] == first[x]).argmax(axis=1)] == key]
                ys = ys[(half[ys, keys:] == half[x, keys:]).any(axis=1)]
                ys = ys[(mark[ys] == mark[x]).mean(axis=1) >= sure]
                for y in ys.tolist():
                    n = len(np.intersect1d(short[x], short[y], assume_unique=True))
                    if 100 * n >= percent * (len(short[x]) + len(short[y]) - n):
                        us.append(node[x])
                        vs.append(node[y])
            if us:
                yield pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80, rows: int = ROWS, keys: int = KEYS) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (smallest id reachable by links, itself included), kept.

    Links join documents with 100 * |intersection| >= percent * |union| of their distinct k-word shingles (a shorter
    text is one shingle). Null and empty texts have no shingles and link with nothing. Rows with a null id link with
    nothing and are kept. Repeated ids: each row is a document of its own; links are between texts. Other columns of
    ``docs``, whatever their names, are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = source.mapInArrow(_sign(k, rows, keys), "doc_id long, n_shingles long, node long, sig binary")
    base = scratch.table(signed, "base")

    known = base.where("node is not null and doc_id is not null")
    nodes = scratch.table(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")), "nodes")
    first = nodes.select("node", "sig").mapInArrow(_first_keys(rows, keys), "key long, node long")
    shared = first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = first.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("first"))  # at most `keys` each
    tensor = members.join(nodes.select("node", "sig"), "node").mapInArrow(_tensor_keys(rows, keys), "bucket long, node long")
    tensor = scratch.table(tensor, "tensor")
    heads = tensor.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = scratch.table(tensor.join(heads, "bucket"), "buckets")
    scratch.drop("tensor")

    wanted = buckets.select("node").distinct().join(nodes.select("node", "doc_id"), "node").select("doc_id")
    texts = source.join(wanted.distinct().hint("shuffle_hash"), "doc_id").select("text")
    sets = scratch.table(texts.mapInArrow(_sets(k), "node long, set binary").dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        p = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u")
        p = p.join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v").select("u", "v", "set_u", "set_v")
        return scratch.table(p.mapInArrow(_confirm(percent), "u long, v long"), name)

    def joined(classes: DataFrame | None, links: DataFrame) -> DataFrame:
        """Links beside what earlier links have joined, a row for each node."""
        return links if classes is None else classes.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)

    labelled, classes = buckets.withColumn("class", F.col("node")), None
    for turn in range(STAR_ROUNDS):
        head = lambda i: F.min(F.struct(F.xxhash64("node", F.lit(LEADERS * turn + i)).alias("h"), "node", "class"))  # noqa: E731, B023
        leaders = labelled.groupBy("bucket").agg(F.array(*(head(i) for i in range(LEADERS))).alias("leaders"))
        pairs = labelled.join(leaders, "bucket").select("node", "class", F.explode("leaders").alias("l")).where("l.class <> class")
        stars = confirmed(pairs.select(F.col("l.node").alias("u"), F.col("node").alias("v")).distinct(), f"stars-{turn}")
        classes = scratch.table(connected(joined(classes, stars), scratch, f"star-{turn}"), f"classes-{turn}")
        labelled = buckets.join(classes, "node", "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("class"))
        mixed = labelled.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("bucket")
        labelled = scratch.table(labelled.join(mixed, "bucket"), f"labelled-{turn}")
        if labelled.isEmpty():
            break
    # what is left: nodes of a mixed bucket, met by their first keys, which all tables of a row share
    left = scratch.table(labelled.select("node", "class").distinct(), "left")
    marks = scratch.table(sets.join(left, "node").mapInArrow(_marks, "node long, mark binary, short binary"), "marks")
    met = left.join(nodes.select("node", "sig"), "node").select("node", "sig").mapInArrow(_first_keys(rows, keys), "key long, node long").join(left, "node")
    mixed = met.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = met.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "class")
    rest = rest.join(nodes.select("node", "sig"), "node").join(marks, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    crossing = scratch.table(rest.mapInArrow(_block_pairs(rows, keys, percent), "u long, v long"), "crossing")
    late = confirmed(crossing, "late")
    if not late.isEmpty():
        classes = scratch.table(connected(joined(classes, late), scratch, "all"), "classes-all")
    scratch.drop("sets", "crossing", "buckets", "late", "left", "marks", *(f"{x}-{t}" for x in ("stars", "labelled") for t in range(STAR_ROUNDS)))

    reps = nodes.join(classes, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("class"))
    lowest = reps.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    home = reps.join(lowest, "class").select("node", "component_id")
    out = base.select("doc_id", "n_shingles", "node").join(home, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
