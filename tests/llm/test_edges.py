"""Odd tables through every operator: empty, nulls in every column, repeated ids and rows, extra columns, one huge token; and models against plain loops."""

import hashlib
import itertools
import math
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from driftwell.functions.scratch import CLEANUP
from driftwell.llm import hmm_score, langid_crf, quality_net, suffix_dedup
from driftwell.llm.chains import forward_backward
from driftwell.llm.decontaminate import contaminated, uncontaminated
from driftwell.llm.hmm_score import score_texts
from driftwell.llm.langid_crf import Labeller, has_letter, identify, train
from driftwell.llm.minhash_dedup import near_duplicates
from driftwell.llm.mixing import mix_sources
from driftwell.llm.pseudonyms import pseudonymise
from driftwell.llm.quality_net import Pool, accepted, classify, index_vectors, shape
from driftwell.llm.sampling import learning_rows
from driftwell.llm.common import Scratch, connected, word_hashes, words_of
from driftwell.llm.suffix_dedup import remove_repeats
from driftwell.llm.toxicity_channel import score_toxicity
from driftwell.llm.vector_graph import near_duplicate_vectors

HUGE = "a1b2" * 50_000
CLASHES = "words string, held_out string, score string, node string, class string, block string, role string, row string, part string, h string, size string, found string, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(2)
    rows = []
    for i in range(60):
        words = [r.choice(["the", "sun", "a", "rises", "over", "hills", "le", "soleil", "sur", "monte"]) for _ in range(r.randint(3, 40))]
        rows.append((i // 2 if i < 20 else i, " ".join(words), r.choice(["en", "fr", None]), r.choice(["x", None])))
    rows += [(None, "the sun rises", "en", "x"), (None, None, None, None), (500, None, "fr", "x"), (501, "", None, None), (502, HUGE, "en", "x"), (503, "² ½ ①", "en", "x"), rows[3], rows[3]]
    clash = tuple("c" for _ in CLASHES.split(","))
    return spark.createDataFrame([(*x, *clash) for x in rows], f"doc_id long, text string, lang string, source string, {CLASHES}")


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (7, None, None), (7, 0, 1), (9_999, 1, 0), (7, 1, 1)]
    return spark.createDataFrame([(*x, "c", "c") for x in rows], "doc_id long, quality int, toxic int, text string, class string")


OPERATORS = {
    "near_duplicates": lambda d, m: near_duplicates(d),
    "identify": lambda d, m: identify(d),
    "pseudonymise": lambda d, m: pseudonymise(d, key="k"),
    "score_texts": lambda d, m: score_texts(d, symbols=5, states=2),
    "classify": lambda d, m: classify(d, m),
    "remove_repeats": lambda d, m: remove_repeats(d),
    "score_toxicity": lambda d, m: score_toxicity(d, m),
    "mix_sources": lambda d, m: mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables_keep_every_row(name, odd, marks):
    operator = OPERATORS[name]
    got = operator(odd, marks).collect()
    assert len(got) == odd.count()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r.doc_id for r in odd.select("doc_id").collect() if r.doc_id is not None)
    assert operator(odd.where("false"), marks).count() == 0
    if name in ("classify", "score_toxicity"):
        assert operator(odd, marks.where("false")).count() == len(got) and operator(odd.where("false"), marks.where("false")).count() == 0


def test_results_do_not_depend_on_the_layout(odd, marks):
    for name in ("identify", "score_texts", "classify", "score_toxicity"):
        columns = {"identify": ["doc_id", "lang_pred", "score"], "score_texts": ["doc_id", "score"]}.get(name, ["doc_id", "score"])
        pick = lambda d: sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in OPERATORS[name](d, marks).select(*columns).collect())  # noqa: E731, B023
        assert pick(odd.coalesce(1)) == pick(odd.repartition(5)), name


def test_texts_without_letters_are_undetermined(odd, marks):
    got = {r.doc_id: r for r in identify(odd).where("doc_id in (500, 501, 503)").collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (500, 501, 503)] == [("und", 0.0)] * 3
    assert not any(has_letter(w.encode()) for w in ("²", "½", "①", "12_", "")) and has_letter("ǅ".encode()) and has_letter(b"1a")


def test_samples_are_rows_not_ids(spark):
    rows = [(1, "text %d" % i, "en" if i % 2 else "fr") for i in range(40)] * 3 + [(2, "rare", "de"), (3, "gone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string").withColumn("text", F.col("text").cast("binary"))
    got = [(r["class"], bytes(r["text"]).decode()) for r in learning_rows(df, 15, Scratch(spark, "test"), "s", "doc_id").collect()]
    assert len(got) == len(set(got)) == 31 and ("de", "rare") in got
    assert all(int(t.split()[1]) % 2 == (c == "en") for c, t in got if c != "de")
    assert got and sorted(got) == sorted((r["class"], bytes(r["text"]).decode()) for r in learning_rows(df.repartition(7), 15, Scratch(spark, "test"), "s", "doc_id").collect())


def test_every_language_can_be_predicted(spark):
    rows = [(i * 4 + k, f"w{i}x w{i}y w{i}z " * 3, f"l{i:03}") for i in range(230) for k in range(4)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=3).select("lang_pred").distinct().count()
    assert got > 200


def test_marginals_equal_enumeration():
    r = np.random.default_rng(4)
    texts = [(lang, " ".join(r.choice(words, 12)).encode()) for lang, words in (("aa", ["ba", "bo", "bi"]), ("bb", ["du", "di", "da"])) for _ in range(20)]
    vocab = sorted({w for _, t in texts for w in words_of(t)})
    model = train([(lang, word_hashes(words_of(t))) for lang, t in texts], vocab, [9] * len(vocab), steps=10)
    probe = [b"ba", b"di", b"qq", b"bo", b"da"]
    ids, start = langid_crf.features(probe, model["lexicon"])
    scores = np.exp(np.add.reduceat(model["weights"][ids], start, axis=0).astype(float))
    total, share = 0.0, np.zeros((5, 2))
    for path in itertools.product(range(2), repeat=5):
        weight = math.prod(scores[i, y] for i, y in enumerate(path)) * math.prod(float(model["trans"][a, b]) for a, b in zip(path, path[1:]))
        total += weight
        for i, y in enumerate(path):
            share[i, y] += weight
    share /= total
    got = Labeller(model).label([b" ".join(probe)])[0]
    best = int(share.sum(axis=0).argmax())
    assert got[0] == model["labels"][best] and got[1] == pytest.approx(share[:, best].mean(), abs=1e-5) and got[2] == 5
    assert got[3] == int(np.abs(np.diff(share.argmax(axis=1))).sum())


def test_pooling_and_network_equal_plain_loops():
    words = [b"Good", b"text", b"of", b"old", b"good", b"!!", b"X9"]
    vocabulary = np.sort(word_hashes([b"good", b"text", b"of"]))
    context = np.random.default_rng(1).normal(size=(3, quality_net.DIM)).astype(np.float32)
    pool = Pool(vocabulary, context)
    table = index_vectors(np.arange(quality_net.SHAPES + quality_net.REPEATS))
    by_shape = [table[int(word_hashes([shape(w)])[0]) % quality_net.SHAPES] for w in words]
    by_word = []
    for w, s in zip(words, by_shape):
        at = np.flatnonzero(vocabulary == word_hashes([w.lower()])[0])
        by_word.append(context[at[0]] if len(at) else s)
    got = pool.pool([b" ".join(words), None, b" \n"])
    assert np.allclose(got[0, : quality_net.DIM], np.mean(by_word, axis=0), atol=1e-5) and np.allclose(got[0, quality_net.DIM : 2 * quality_net.DIM], np.mean(by_shape, axis=0), atol=1e-5)
    assert not got[1:].any()
    r = np.random.default_rng(2)
    x, y = r.normal(size=(60, 5)).astype(np.float32), np.arange(60) % 2
    net = quality_net.Net(x, y.astype(float), hidden=4, steps=20)
    for row in x[:5]:
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.std)]
        hidden = [max(0.0, sum(z[i] * net.p[0][i][j] for i in range(5)) + net.p[1][j]) for j in range(4)]
        logit = sum(h * w for h, w in zip(hidden, net.p[2])) + net.p[3][0]
        assert net.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)), abs=1e-6)


def test_targets_equal_an_independent_count(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (990, "a"), (5, "b"), (300, "c"), (0, "d"), (40, None)])]
    got = {r.source: r.target for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=4).collect()}
    total = 1345.0  # weights 1 2 3 1 2 of nine; b, d and null stop at 15, 0 and 120 words
    assert 2 * total / 9 > 120 and got["b"] == 15 and got["d"] == 0 and got[None] == 120
    left = total - 15 - 120  # a and c share it 1 to 3, so c, with 907.5, stops at 900, and a takes what is left
    assert left * 3 / 4 > 900 and got["c"] == 900 and got["a"] == pytest.approx(left - 900)


def test_components_of_a_hub_and_chains(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(10_000, 10_200)] + [(2999, 5000), (5000, 5001), (7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), "c").collect()}
    assert {got[i] for i in range(3000)} == {0} and got[5001] == 0 and {got[i] for i in range(10_000, 10_201)} == {10_000} and 7 in got


def test_contamination_of_odd_tables(spark, odd):
    items = spark.createDataFrame([(1, "the sun rises", "c"), (1, "the sun rises", "c"), (None, "x y", "c"), (2, None, "c"), (3, "", "c"), (4, HUGE, "c")], "item_id long, text string, doc_id string")
    found = [(r.doc_id, r.item_id) for r in contaminated(odd, items).collect()]
    assert (502, 4) in found and found.count((None, 1)) == 2 and not {i for _, i in found} & {2, 3, None}
    rest = uncontaminated(odd, items)
    assert rest.columns == odd.columns and rest.where("doc_id = 502").count() == 0 and rest.where("text is null").count() == odd.where("text is null").count()


def test_vectors_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (None, [1.0, 0.0], "a")]
    df = spark.createDataFrame([(*x, 5, 5, 5) for x in rows], "vec_id long, embedding array<double>, label string, node int, n_links int, copies int")
    got = sorted(near_duplicate_vectors(df).collect(), key=str)
    assert len(got) == 5 and {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id == 2} == {2: (3, 1)}
    assert [r.n_links for r in got if r.vec_id == 3] == [0] and [(r.component_id, r.kept) for r in got if r.vec_id is None] == [(None, True)]


def test_pipeline_on_odd_tables(spark, tmp_path, odd, marks):
    import corpus_pipeline as cp

    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    items = spark.createDataFrame([], "item_id long, text string")
    for name, d, m in (("odd", docs, marks), ("empty", docs.where("false"), marks.where("false")), ("unlabelled", docs, marks.where("false"))):
        path = f"{tmp_path}/{name}"
        d.write.parquet(f"{path}/documents.parquet")
        m.select("doc_id", "quality", "toxic").write.parquet(f"{path}/labels.parquet")
        items.write.parquet(f"{path}/benchmark.parquet")
        got = cp.run(spark, path).collect()
        assert {"doc_id", "taken"} <= set(got[0].asDict()) if got else name == "empty"
    assert accepted(docs, marks.where("false")).count() == docs.count()  # without labels the score is one half, above the cut
    assert forward_backward(np.ones((1, 2)), np.array([0]), np.array([1]), np.ones((2, 2)), np.full(2, 0.5))[0].tolist() == [[0.5, 0.5]]


def _peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pooling_takes_little_memory_at_once():
    texts = [" ".join(f"w{i}x{j}" for j in range(10_000)).encode() for i in range(10)]
    pool = Pool(np.sort(word_hashes(texts[0].split())), np.zeros((10_000, quality_net.DIM), np.float32))
    pool.pool(texts)  # the words are cached then
    assert _peak_mb(lambda: pool.pool(texts)) < 60


def test_uses_of_words_add_up_in_any_order_in_little_memory():
    r = np.random.default_rng(5)
    words = r.integers(0, 300_000, 600_000)
    words[:100] = 7  # more steps than a row holds
    uses = r.integers(0, hmm_score.USE + 1, (len(words), 8)).astype(np.uint16)

    def summed(cuts):
        rows = [b for b in hmm_score._added(8)([_sorted([hmm_score.summed_uses([w], [u]) for w, u in zip(np.split(words, cuts), np.split(uses, cuts))])])]
        return [np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("word", "q0", "q1")]

    one, many = summed([]), summed([50, 1000, 200_000])
    assert all((a == b).all() for a, b in zip(one, many))
    at = np.flatnonzero(one[0] == 7)[0]
    want = uses[words == 7].sum(axis=0, dtype=float) / hmm_score.USE
    assert np.allclose(hmm_score.unpacked([one[1][at : at + 1], one[2][at : at + 1]], 8)[0], want, rtol=5e-4)
    assert _peak_mb(lambda: hmm_score.summed_uses([words], [uses])) < 70


def test_known_words_travel_packed_by_block():
    r = np.random.default_rng(8)
    n = 60_000
    block, word, uses = r.integers(0, 3, n), r.permutation(n).astype(np.int64) * 2**40, np.minimum(r.zipf(1.5, n), 10**9)
    steps = r.integers(0, hmm_score.MOST + 1, (n, 6)).astype(np.uint16)
    hidden = uses < 3
    t = pa.table({"block": block, "word": word, "c": uses} | {f"q{k}": pa.array(q, mask=hidden) for k, q in enumerate(hmm_score._longs(steps))})
    rows = pa.Table.from_batches([b for b in hmm_score._by_block(6)(t.to_batches(max_chunksize=7_000))])
    assert rows.num_rows == 3 and sum(len(x) for c in ("rare", "uses", "own") for x in rows.column(c).to_pylist()) < 8 * n + 2 * n + 12 * (~hidden).sum() + 3_000
    for b in range(3):
        words, c, places, own = hmm_score.words_of_block(rows.filter(pc.equal(rows.column("block"), b)), 6)
        assert dict(zip(words, c)) == dict(zip(word[block == b], uses[block == b]))
        at = np.searchsorted(word[by := np.argsort(word)], words[places])
        assert len(places) == (~hidden & (block == b)).sum() and np.array_equal(own, hmm_score._counts(steps[by[at]]))
    assert [len(x) for x in hmm_score.words_of_block(rows.slice(0, 0), 6)] == [0] * 4 and not list(hmm_score._by_block(6)(t.slice(0, 0).to_batches()))


def test_learning_leaves_no_shuffle_files(spark, odd):
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(CLEANUP, None)
    scores = score_texts(odd, symbols=5, states=2)
    end = time.monotonic() + 20
    while (left := files() - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP, None) == setting
    assert scores.count() == odd.count()


def _sorted(batches):
    t = pa.Table.from_batches(batches).sort_by("word")
    return t.combine_chunks().to_batches()[0]


def test_removed_runs_equal_marked_bytes():
    r = random.Random(6)
    for _ in range(300):
        text = bytes(r.randrange(256) for _ in range(r.randint(50, 300)))
        runs = [(a, r.randint(a + 1, len(text) - 49)) for a in (r.randrange(len(text) - 49) for _ in range(r.randint(0, 4)))]
        gone = [any(a <= i < b + 49 for a, b in runs) for i in range(len(text))]
        spans = sum(x and not y for x, y in zip(gone, [False, *gone]))
        kept = bytes(c for c, x in zip(text, gone) if not x)
        assert suffix_dedup.cut_out(text, runs) == (sum(gone), spans, hashlib.sha256(kept).hexdigest())
