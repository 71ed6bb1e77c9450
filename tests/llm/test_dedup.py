"""Near duplicates of texts and vectors, repeated strings: against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest

from driftwell.llm.common import word_hashes, words_of
from driftwell.llm.minhash_dedup import near_duplicates, shingle_set
from driftwell.llm.suffix_dedup import common_prefixes, remove_repeats, repeated, suffix_array
from driftwell.llm.vector_graph import audit_recall, near_duplicate_vectors

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "mé", "sha") for b in ("n", "r", "st", "", "x", "lo")]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_are_ascii_lowered_and_cut_at_ascii_blanks():
    assert words_of("ÀB c d\x0be\x1cf".encode()) == ["Àb".encode(), "c d".encode(), b"e\x1cf"]
    assert words_of(None) == [] and len(word_hashes([])) == 0


@pytest.fixture(scope="module")
def documents():
    r = random.Random(5)
    docs = {}
    for i in range(40):
        docs[i] = text(r, r.randint(1, 80))
    base = text(r, 90).split()
    for i in range(100, 160):  # a group of near copies, not all of which are near to each other
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        docs[i] = " ".join(w)
    shared = text(r, 60)
    for i in range(200, 230):  # one passage, own rests
        docs[i] = shared + " " + text(r, r.randint(5, 40))
    docs |= {300: docs[100].upper(), 301: "", 302: None, 303: "  \n", 304: "ba do", 305: "BA\tdo", 306: "ba", 307: text(r, 20_000)}
    return docs


def test_near_duplicates_equal_brute_force(spark, documents):
    rows = [(i, t, None if i % 3 else "x") for i, t in documents.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    sets = {i: set(shingle_set(t.encode() if t else None, 4).tolist()) for i, t in documents.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert len(links) > 200
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(sets[i]) for i, r in got.items())


def test_near_duplicates_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(df).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def removed(docs, length=50):
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_remove_repeats_equals_brute_force(spark, documents):
    r = random.Random(1)
    docs = list(documents.items()) + [(400, "ab" * 500), (401, "ab" * 300), (402, "\0" * 120), (403, "x" + "\0" * 80), (404, documents[100][10:90] + " " + text(r, 30) + documents[100][5:70])]
    docs += [(500 + k, documents[7]) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(df).collect()}
    assert got == removed(docs)
    assert remove_repeats(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "q" * 60), (1, "q" * 60), (1, "q" * 70)], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.n_removed) for x in remove_repeats(odd).collect()) == [(0, 0), (1, 0), (1, 0)]


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    data = np.concatenate([r.integers(97, 99, 400), np.tile(r.integers(97, 120, 70), 4)]).astype(np.uint8)
    sa = suffix_array(data)
    cut = lambda i: data[i : i + 50].tobytes().ljust(50, b"\0")
    assert sorted(sa.tolist()) == list(range(len(data)))
    assert all(cut(a) <= cut(b) for a, b in zip(sa[:-1], sa[1:]))
    lcp = common_prefixes(data, sa)
    for k in range(1, len(sa)):
        a, b = cut(sa[k - 1]), cut(sa[k])
        want = next((j for j in range(50) if a[j] != b[j]), 50)
        assert lcp[k] == want or (lcp[k] >= want and max(sa[k], sa[k - 1]) + want >= len(data))


def test_pieces_of_a_shard_are_merged_by_search():
    r = random.Random(2)
    parts = [bytes(r.choices(range(97, 123), k=80)) for _ in range(6)]
    segments = [parts[i % 6][: 60 + i] for i in range(18)]
    docs, sizes = np.array([(i * 7) % 18 for i in range(18)]), np.array([len(s) for s in segments])
    blob = np.frombuffer(b"".join(segments), np.uint8)
    want = set()
    for i, s in enumerate(segments):
        earlier = {t[p : p + 50] for t, d in zip(segments, docs) if d < docs[i] for p in range(len(t) - 49)}
        want |= {(i, p) for p in range(len(s) - 49) if s[p : p + 50] in earlier}
    for piece in (100, 10_000):
        got = {(int(g), p) for g, a, b in zip(*repeated(blob, sizes, docs, piece)) for p in range(a, b)}
        assert got == want and want


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(9)
    rows = []
    for label in (0, 1):
        for g in range(12):
            base = r.normal(size=16)
            for _ in range(int(r.integers(1, 25))):
                rows.append((len(rows), (base + r.normal(size=16) * 0.12).astype(np.float32).tolist(), label))
        rows += [(len(rows) + k, rows[-1][1], label) for k in range(30)]  # copies
    crowd = r.normal(size=16)
    for _ in range(1500):  # one hot cluster, above a shard
        rows.append((len(rows), (crowd + r.normal(size=16) * 0.14).astype(np.float32).tolist(), 1))
    odd = [(90_000, None, 1), (90_001, [0.0] * 16, 1), (90_002, [float("nan")] * 16, 1), (90_003, [1.0] * 16, None), (90_004, [1.0] * 16, None), (90_005, [], 1), (90_006, [None] * 16, 0), (90_007, [2.0] * 3, 0), (90_008, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in near_duplicate_vectors(df).collect()}
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([c for _, _, c in rows])
    links = (x @ x.T >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(links, False)
    count = links.sum(axis=1)
    mine = np.array([got[i].n_links for i, _, _ in rows])
    assert count.sum() > 10_000
    assert (mine <= count).all() and mine.sum() >= 0.99 * count.sum()
    assert audit_recall(df, near_duplicate_vectors(df)) >= 0.9
    want = components([i for i, _, _ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(np.triu(links)))])
    assert np.mean([got[i].component_id == want[i] for i, _, _ in rows]) > 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _, _ in odd if i < 90_007)
    assert got[90_008].n_links == 1 and got[90_008].component_id == 90_007
    assert near_duplicate_vectors(df.where("false")).count() == 0
