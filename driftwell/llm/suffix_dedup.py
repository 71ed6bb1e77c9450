"""Removal of repeated 50-byte strings by sharded suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

Sharding follows the content. The minimiser of a string is the smallest hash among its runs of ``GRAM`` bytes, so equal
strings have equal minimisers and meet in one shard, whatever stands around them. Neighbouring strings of a text that
share a minimiser travel as one segment.

1. Minimisers that only one text has cannot be in a repeat. Texts' minimisers are sent, packed, to buckets, which
   return to every text those that another text has as well.
2. Texts cut their segments at the returned minimisers. Equal segments within a task are sent once, for the smallest
   document; the others are marked at once, so that a passage common to all texts stays small.
3. A shard sorts its suffixes by Larsson-Sadakane refinement, up to ``LENGTH`` bytes; Kasai's recurrence gives the common
   prefixes, and runs of common prefixes of full length are classes of equal strings. A shard above ``PIECE`` bytes is
   cut into pieces in order of document; the sorted classes of earlier pieces are merged by binary search.
4. Marked runs return to their texts, which drop the covered bytes.

Copies of a whole text are one text here; all but the one with the smallest id are removed as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, groups, mix64

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
PIECE = 2_000_000
PACK = "part int, role int, key long, doc long, text binary, a binary, b binary, c binary, d binary, e binary"
EMPTY = hashlib.sha256(b"").hexdigest()


def minimisers(data: np.ndarray) -> np.ndarray:
    """The minimiser of the string at each place of the bytes; len(data) - LENGTH + 1 of them."""
    b = data.astype(U64)
    h4 = b[:-3] | (b[1:-2] << U64(8)) | (b[2:-1] << U64(16)) | (b[3:] << U64(24))
    h8 = h4[:-4] | (h4[4:] << U64(32))
    h16 = mix64(h8[:-8] * U64(0x9E3779B97F4A7C15) + mix64(h8[8:]))
    h = mix64(h16[:-4] * U64(0xD1B54A32D192ED03) + h4[16 : 16 + len(h16) - 4])
    size = 1
    while 2 * size <= WINDOW:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (WINDOW - size)], h[WINDOW - size :]) if size < WINDOW else h


def runs_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start places and minimisers of the runs of one minimiser; data: at least LENGTH bytes."""
    m = minimisers(data)
    at = np.append(0, np.flatnonzero(m[1:] != m[:-1]) + 1)
    return at, m[at]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order of their first LENGTH bytes (of what follows, zeros past the end)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(U64)
    sa = np.argsort(first).astype(np.int32)
    rank = np.zeros(n + LENGTH, np.int32)  # a group's rank is the place of its first suffix, plus one; 0 past the end
    key, place, depth = first[sa], np.arange(n, dtype=np.int32), 8
    while True:
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        rank[sa[place]] = np.repeat(place[heads] + 1, np.diff(np.append(heads, len(place))))
        if depth >= LENGTH:
            return sa
        place = place[~(new & np.append(new[1:], True))]  # groups of one are done
        if not len(place):
            return sa
        step = min(depth, LENGTH - depth)  # ranks at a lower offset overlap, and complete the length
        sub = sa[place]
        key = (rank[sub].astype(np.int64) << 32) | rank[sub + step]
        order = np.argsort(key)
        sa[place], key = sub[order], key[order]
        depth += step


def common_prefixes(data: np.ndarray, sa: np.ndarray, chain: int = 64) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in the array, up to LENGTH; many chains in step.

    In a chain of neighbouring places the prefix shrinks by one at most from place to place; every chain starts anew.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(LENGTH + 1, np.uint8)])
    before = np.empty(n, np.int32)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    out = np.zeros(n, np.int8)  # by place
    heads = np.arange(0, n, chain)
    size = np.zeros(len(heads), np.int64)
    for step in range(min(chain, n)):
        p = heads[: np.searchsorted(heads, n - step)] + step
        size, q = size[: len(p)], before[p]
        tied = np.flatnonzero(size == LENGTH)  # order beyond LENGTH is open, so nothing carries over from a full prefix
        size = np.maximum(size - 1, 0)
        for a in range(0, len(tied), 20_000):
            t = tied[a : a + 20_000]
            same = padded[p[t][:, None] + np.arange(LENGTH)] == padded[q[t][:, None] + np.arange(LENGTH)]
            size[t] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
        size[q < 0] = 0
        todo = np.flatnonzero((q >= 0) & (size < LENGTH))
        while len(todo):
            same = padded[p[todo] + size[todo]] == padded[q[todo] + size[todo]]
            todo = todo[same]
            size[todo] += 1
            todo = todo[size[todo] < LENGTH]
        out[p] = size
    return out[sa]


def repeated(blob: np.ndarray, sizes: np.ndarray, docs: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the runs of places whose string starts in a smaller document's segment too.

    Segments of ``sizes`` bytes stand one after another in ``blob``; segment i is of document docs[i].
    """
    at = np.cumsum(sizes) - sizes
    order = np.argsort(docs, kind="stable")
    cuts = np.append(0, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // piece)) + 1)
    known, known_doc = np.zeros(0, f"S{LENGTH + 1}"), np.zeros(0, np.int64)
    found: list[tuple] = []
    for start, stop in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        mine = order[start:stop]
        size = sizes[mine]
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(mine), dtype=np.int32), size)
        inside = np.arange(len(owner)) - base[owner]
        data = blob[at[mine][owner] + inside]
        valid = inside <= size[owner] - LENGTH
        sa = suffix_array(data)
        cls = np.cumsum(common_prefixes(data, sa) < LENGTH)
        keep = valid[sa]
        sa, cls = sa[keep], cls[keep]
        heads = np.append(0, np.flatnonzero(cls[1:] != cls[:-1]) + 1)
        doc = docs[mine][owner[sa]]
        least = np.minimum.reduceat(doc, heads)
        if len(known) or stop < len(order):
            windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(LENGTH, np.uint8)), LENGTH)[sa[heads]]
            strings = np.concatenate([windows, np.ones((len(heads), 1), np.uint8)], axis=1).view(f"S{LENGTH + 1}").ravel()  # the last byte keeps zeros before it
            where = np.searchsorted(known, strings)
            hit = np.zeros(len(strings), bool)
            there = where < len(known)
            hit[there] = known[where[there]] == strings[there]
            least[hit] = np.minimum(least[hit], known_doc[where[hit]])
            known, known_doc = np.insert(known, where[~hit], strings[~hit]), np.insert(known_doc, where[~hit], least[~hit])
        marked = np.sort(sa[doc > np.repeat(least, np.diff(np.append(heads, len(sa))))])
        if len(marked):
            own = owner[marked]
            first = np.append(True, (np.diff(marked) > 1) | (np.diff(own) > 0))
            last = np.append(first[1:], True)
            found.append((mine[own[first]], inside[marked[first]], inside[marked[last]] + 1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _packed(part: np.ndarray, role: int, *columns: np.ndarray):
    """A row for each part, its values packed."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    heads = np.append(0, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(part) else np.zeros(0, int)
    ends = np.append(heads[1:], len(part)) if len(heads) else heads
    n = len(heads)
    arrays = [[c[a:b].tobytes() for a, b in zip(heads, ends, strict=True)] for c in columns]
    arrays += [[None] * n] * (5 - len(arrays))
    nulls = pa.nulls(n, pa.int64())
    return pa.record_batch(
        [pa.array(part[heads].astype(np.int32)), pa.array(np.full(n, role, np.int32)), nulls, nulls, pa.nulls(n, pa.binary()), *(pa.array(a, pa.binary()) for a in arrays)],
        ["part", "role", "key", "doc", "text", "a", "b", "c", "d", "e"],
    )


def _slices(batch, least: int = LENGTH, most: int = 2_000_000):
    """Pieces of a batch (key, doc, text) of about ``most`` bytes, without shorter texts."""
    got, size = [], 0
    for key, doc, text in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist(), batch.column("text"), strict=True):
        t = text.as_buffer()
        if t.size >= least:
            got.append((key, doc, np.frombuffer(t, np.uint8)))
            size += t.size
            if size >= most:
                yield got
                got, size = [], 0
    if got:
        yield got


def _anchors(buckets: int):
    def run(batches):
        done: set[int] = set()
        keys, texts, held = [], [], 0
        for batch in batches:
            for rows in _slices(batch):
                for key, _, data in rows:
                    if key in done:
                        continue
                    if len(done) < 1_000_000:
                        done.add(key)
                    m = np.unique(runs_of(data)[1])
                    keys.append(m)
                    texts.append(np.full(len(m), key, np.int64))
                    held += len(m)
                if held > 2_000_000:
                    m = np.concatenate(keys)
                    yield _packed((m % U64(buckets)).astype(np.int64), 0, (m >> U64(32)).astype(np.uint32), np.concatenate(texts))
                    keys, texts, held = [], [], 0
        if held:
            m = np.concatenate(keys)
            yield _packed((m % U64(buckets)).astype(np.int64), 0, (m >> U64(32)).astype(np.uint32), np.concatenate(texts))

    return run


def _shared(parts: int):
    """For each bucket, the minimisers that several texts have, packed by those texts' parts."""

    def run(batches):
        for t in groups(batches, ["part"]):
            bucket = t.column("part")[0].as_py()
            m = np.frombuffer(b"".join(t.column("a").to_pylist()), np.uint32)
            text = np.frombuffer(b"".join(t.column("b").to_pylist()), np.int64)
            order = np.lexsort((text, m))
            m, text = m[order], text[order]
            new = np.append(True, m[1:] != m[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
            other = np.zeros(len(m), bool)  # marks the first of each minimiser that has a second text
            np.logical_or.at(other, head[text != text[head]], True)
            hit = other[head]
            code = (np.int64(bucket) << 32) | m[hit].astype(np.int64)
            yield _packed(text[hit] % parts, 0, text[hit], code)

    return run


def _texts(batches):
    """Texts, without copies that stood in the same task with a smaller or equal document."""
    seen: dict[int, int] = {}
    for batch in batches:
        keep = []
        for key, doc in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist(), strict=True):
            fresh = doc < seen.get(key, 1 << 63)
            keep.append(fresh)
            if fresh and (key in seen or len(seen) < 1_000_000):
                seen[key] = doc
        kept = batch.filter(pa.array(keep, pa.bool_()))
        pack = zstandard.ZstdCompressor(level=3).compress
        yield kept.set_column(2, "text", pa.array([pack(x.as_buffer()) for x in kept.column("text")], pa.binary()))


def _cut(buckets: int, shards: int):
    """A part's texts: those without shared minimisers are done (role 3); others are kept (2), with segments for the
    shards (0) and runs that another segment of the task has already covered (1)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        part, codes, owners, last = None, None, None, None
        held: list = []
        size = 0
        for batch in batches:
            rows: list = []
            keys, docs = batch.column("key").to_pylist(), batch.column("doc").to_pylist()
            for i, (p, role) in enumerate(zip(batch.column("part").to_pylist(), batch.column("role").to_pylist(), strict=True)):
                if p != part:
                    if held:
                        yield from _send(held, part, shards)
                    part, codes, owners, last, held, size = p, [], [], None, [], 0
                if role == 0:
                    owners.append(np.frombuffer(batch.column("a")[i].as_buffer(), np.int64))
                    codes.append(np.frombuffer(batch.column("b")[i].as_buffer(), np.int64))
                    continue
                if isinstance(codes, list):
                    owners, codes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, codes))
                    order = np.lexsort((codes, owners))
                    owners, codes = owners[order], codes[order]
                key, doc = keys[i], docs[i]
                if key == last:
                    continue  # a copy; the smallest document came first
                last = key
                packed = batch.column("text")[i].as_buffer()
                text = unpack(packed)
                mine = codes[np.searchsorted(owners, key, "left") : np.searchsorted(owners, key, "right")]
                hit = np.zeros(0, bool)
                if len(mine):
                    data = np.frombuffer(text, np.uint8)
                    at, m = runs_of(data)
                    code = ((m % U64(buckets)).astype(np.int64) << 32) | (m >> U64(32)).astype(np.int64)
                    where = np.minimum(np.searchsorted(mine, code), len(mine) - 1)
                    hit = mine[where] == code
                if not hit.any():
                    rows.append((part, 3, key, doc, None, hashlib.sha256(text).hexdigest().encode()))
                    continue
                rows.append((part, 2, key, doc, packed.to_pybytes(), None))
                end = np.append(at[1:], len(data) - LENGTH + 1)
                held.append((key, doc, text, at[hit], end[hit], m[hit]))
                size += len(text)
                if size > 16_000_000:
                    yield from _send(held, part, shards)
                    held, size = [], 0
            if rows:
                yield _rows(rows)
        if held:
            yield from _send(held, part, shards)

    return run


def _rows(rows: list):
    part, role, key, doc, text, a = (list(x) for x in zip(*rows, strict=True))
    return pa.record_batch(
        [pa.array(part, pa.int32()), pa.array(role, pa.int32()), pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(text, pa.binary()), pa.array(a, pa.binary()), *(pa.nulls(len(rows), pa.binary()) for _ in range(4))],
        ["part", "role", "key", "doc", "text", "a", "b", "c", "d", "e"],
    )


def _send(held: list, part: int, shards: int):
    pieces, name = [], []
    for _, _, raw, at, end, _ in held:
        own = [raw[a : e + LENGTH - 1] for a, e in zip(at.tolist(), end.tolist(), strict=True)]
        pieces += own
        name += map(xxhash.xxh3_64_intdigest, own)
    n = [len(h[3]) for h in held]
    name = np.array(name, U64)
    doc = np.repeat(np.array([h[1] for h in held]), n)
    key = np.repeat(np.array([h[0] for h in held]), n)
    at, end, m = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
    order = np.lexsort((doc, name))
    new = np.append(True, name[order][1:] != name[order][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > doc[order][head]
    if later.any():
        yield _packed(np.full(int(later.sum()), part), 1, key[later], at[later], end[later])
    go = np.flatnonzero(~later)
    shard = ((m[go] >> U64(20)) % U64(shards)).astype(np.int64)
    go, shard = go[np.argsort(shard, kind="stable")], np.sort(shard)
    batch = _packed(shard, 0, key[go], doc[go], at[go], np.array([len(pieces[i]) for i in go]))
    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(1, int)
    pack = zstandard.ZstdCompressor(level=3).compress
    blobs = [pack(b"".join(pieces[i] for i in go[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    yield batch.set_column(9, "e", pa.array(blobs, pa.binary()))


def _shard(parts: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for t in groups(batches, ["part"]):
            key, doc, at, size = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in "abcd")
            blob = np.frombuffer(b"".join(map(unpack, t.column("e").to_pylist())), np.uint8)
            segment, start, stop = repeated(blob, size, doc)
            if len(segment):
                k = key[segment]
                yield _packed(k % parts, 1, k, start + at[segment], stop + at[segment])

    return run


def cut_out(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes and spans removed, and the digest of the rest; runs: first and last place, plus one, of strings to go."""
    left, end, gone, spans = hashlib.sha256(), 0, 0, 0
    for a, b in sorted(runs):
        b = min(b + LENGTH - 1, len(text))
        if b <= end:
            continue
        if a > end or not spans:
            left.update(text[end:a])
            spans += 1
            gone += b - a
        else:
            gone += b - end
        end = b
    left.update(text[end:])
    return gone, spans, left.hexdigest()


def _finish(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    part, runs = None, None
    for batch in batches:
        out = []
        keys, docs = batch.column("key").to_pylist(), batch.column("doc").to_pylist()
        for i, (p, role) in enumerate(zip(batch.column("part").to_pylist(), batch.column("role").to_pylist(), strict=True)):
            if p != part:
                part, runs = p, []
            if role == 1:
                runs.append([np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in "abc"])
                continue
            if isinstance(runs, list):
                runs = [np.concatenate(x) for x in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 3
                order = np.argsort(runs[0], kind="stable")
                runs = tuple(x[order] for x in runs)
            a, b = runs[0].searchsorted(keys[i], "left"), runs[0].searchsorted(keys[i], "right")
            out.append((keys[i], docs[i], *cut_out(unpack(batch.column("text")[i].as_buffer()), list(zip(runs[1][a:b].tolist(), runs[2][a:b].tolist(), strict=True)))))
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], ["key", "first", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A null text is empty; texts under 50 bytes lose nothing. Rows with a null id lose nothing and take nothing from
    others. Rows of one id are one document as to repeats (none is smaller), each with its own text. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    ids = base.select("doc", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("doc").isNull() | (F.octet_length("text") < LENGTH), F.sha2("text", 256)).alias("whole"))
    total = ids.agg(F.sum("n_bytes")).first()[0] or 0
    buckets, parts, shards = (int(min(1 << 30, max(12, total // size))) for size in (8_000_000, 8_000_000, 1_000_000))
    long = base.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH)).select(F.xxhash64("text").alias("key"), "doc", "text")
    names = [c.split()[0] for c in PACK.split(", ")]

    def dealt(df: DataFrame, n: int, *order: str) -> DataFrame:
        return df.repartition(n, "part").sortWithinPartitions("part", *order)

    anchors = long.mapInArrow(_anchors(buckets), PACK)
    shared = dealt(anchors.select("part", "a", "b"), min(buckets, 50_000)).mapInArrow(_shared(parts), PACK)
    texts = long.mapInArrow(_texts, "key long, doc long, text binary").select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "key", "doc", "text", *(F.lit(None).cast("binary").alias(c) for c in "abcde"))
    both = dealt(shared.select(*names).union(texts.select(*names)), min(parts, 50_000), "role", "key", "doc")
    cut = scratch.table(both.mapInArrow(_cut(buckets, shards), PACK), "cut")
    found = dealt(cut.where("role = 0").select("part", *"abcde"), min(shards, 50_000)).mapInArrow(_shard(parts), PACK)
    back = cut.where("role in (1, 2)").select(*names).union(found.select(*names)).select("part", "role", "key", "doc", "text", *"abc")
    ended = dealt(back, min(parts, 50_000), "role", "key").mapInArrow(_finish, "key long, first long, n_removed long, n_spans long, kept_sha256 string")
    clean = cut.where("role = 3").select("key", F.col("doc").alias("first"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("a").cast("string").alias("kept_sha256"))
    ended = scratch.table(ended.union(clean), "ended")
    scratch.drop("cut")
    out = ids.join(ended, "key", "left")
    alone, copy = F.col("whole").isNotNull(), F.col("doc") > F.col("first")
    pick = lambda short, gone, kept: F.when(alone, short).when(copy, gone).otherwise(kept)
    return out.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        pick(F.lit(0).cast("long"), F.col("n_bytes"), F.col("n_removed")).alias("n_removed"),
        pick(F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("n_spans")).alias("n_spans"),
        pick(F.col("whole"), F.lit(EMPTY), F.col("kept_sha256")).alias("kept_sha256"),
    )
