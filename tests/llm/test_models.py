"""Learned operators: held-out accuracy, exact recursions, odd rows."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm.common import Scratch
from driftwell.llm.chains import forward, forward_backward, longest_first
from driftwell.llm.hmm_score import score_texts
from driftwell.llm.langid_crf import identify
from driftwell.llm.quality_net import accepted, classify
from driftwell.llm.sampling import all_labelled_rows
from driftwell.llm.toxicity_channel import Channel, Scorer, Words, chance, features, learn, score_toxicity, spaced, trimmed

SYLLABLES = {"aa": ["the", "ing", "on", "er", "and"], "bb": ["que", "ción", "ado", "ez", "la"], "cc": ["ung", "heit", "sch", "ß", "ver"]}


def word(r, lang):
    return "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3)))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    rows = []
    for i in range(400):
        lang = r.choice(list(SYLLABLES))
        words = [word(r, lang) for _ in range(r.randint(5, 90))]
        quality, toxic = int(r.random() > 0.3), int(r.random() < 0.3)
        if not quality:
            words = [w + "***" for w in words] if i % 2 else [words[0]] * len(words)
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["scoundrel", "sc0undrel", "scoundrelll", "rotten", "r0tt3n"]))
        rows.append((i, " ".join(words), lang, quality, toxic))
    return rows + [(900, None, None, None, None), (901, "", "aa", None, None), (902, "123 ... 4", None, 1, 0), (903, "the " * 20_000, None, None, None)]


def frames(spark, corpus):
    docs = spark.createDataFrame([(i, t, lang, "src") for i, t, lang, _, _ in corpus], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, q, x) for i, _, _, q, x in corpus], "doc_id long, quality int, toxic int")
    return docs, labels


def held(i, k, out):
    return zlib.crc32(str(i).encode()) % k == out


def test_language(spark, corpus):
    docs, _ = frames(spark, corpus)
    got = {r.doc_id: r for r in identify(docs, per_language=60).collect()}
    out = [i for i, *_ in corpus[:400] if held(i, 4, 2)]
    assert all(got[i].held_out == held(i, 4, 2) for i in got)
    assert np.mean([got[i].lang_pred == corpus[i][2] for i in out]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "aa" and 0 <= got[903].score <= 1
    assert identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_switched_text(spark, corpus):
    r = random.Random(8)
    mixed = " ".join([word(r, "aa") for _ in range(30)] + [word(r, "cc") for _ in range(30)])
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _, _ in corpus[:200]] + [(1002, mixed, None)], "doc_id long, text string, lang string")
    got = identify(docs, per_language=60).where("doc_id = 1002").first()
    assert 1 <= got.n_switches <= 3 and 0.35 < got.score < 0.65


def test_quality_and_its_filter(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    out = [i for i, *_ in corpus[:400] if held(i, 5, 0)]
    assert np.mean([got[i].predicted == corpus[i][3] for i in out]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == len(corpus)
    kept = accepted(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert {r.score for r in classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in classify(docs, labels.where("false")).collect()} == {0.5}


def test_toxicity(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    out = [i for i, *_ in corpus[:400] if held(i, 5, 0)]
    assert np.mean([got[i].predicted == corpus[i][4] for i in out]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[900].predicted == got[901].predicted == 0
    assert {r.score for r in score_toxicity(docs, labels.where("false")).collect()} == {0.0}


def test_channel_restores_disguised_words():
    c = Channel({"rotten": 30, "scoundrel": 30, "the": 500, "cat": 50, "tore": 10, "note": 12})
    s = Scorer(c.words, {}, (1.0, 0.0))
    for seen, want in {"r0tt3n": "rotten", "sc0undre1": "scoundrel", "rrrotten": "rotten", "r.o.t.t.e.n": "rotten", "c@t": "cat", "the": "the", "12": "", "the!!": "the"}.items():
        assert s.reader.word(seen) == want


def test_channel_restores_words_disguised_at_their_end():
    c = Channel({"idiot": 30, "trash": 30, "ass": 40, "as": 90, "a": 300, "the": 500, "cat": 50, "scoundrel": 30})
    s = Scorer(c.words, {}, (1.0, 0.0))
    for seen, want in {"idio+": "idiot", "idio+!": "idiot", "(idio+).": "idiot", "tra$#": "trash", "as$": "ass", "scoundre|": "scoundrel", "the***": "the", "the,!!": "the", "cat!": "cat", "cat$": "cat"}.items():
        assert s.reader.word(seen) == want


def test_spaced_runs_are_split_into_words():
    c = Channel({"idiot": 30, "you": 500, "are": 300, "an": 200, "class": 40, "hit": 30, "shit": 20, "id": 3, "it": 100})
    assert c.split("y0uare-an1d!ot") == ["you", "are", "an", "idiot"]
    assert c.split("classhit") == ["class", "hit"]
    assert c.split("xqzidiotly") == ["xqz", "idiot", "ly"]
    s = Scorer(c.words, {f: 1.0 for f in features("idiot")}, (1.0, 0.0))
    for text in ("y o u i d i o t", "y o u a r e a n i d i o t i t i s", "i  d  i  o  t", "i\nd\ni\no\nt", "you id iot.", "you i d iot!"):
        assert s.total(text)[1] == ["idiot"], text
    assert s.total("id it you")[1] == []


def learnt(spark, texts):
    scratch = Scratch(spark, "test")
    rows = spark.createDataFrame([(c, t.encode()) for c, t in texts], "class int, text binary")
    return learn(rows, scratch)


def test_toxic_words_that_are_rare_among_toxic_texts_are_learned(spark):
    r = random.Random(8)
    texts = [(i % 2, " ".join(r.choice(["lamp", "river", "stone", "cloud", "green", "paper", "seven", "table"]) + word(r, "aa") for _ in range(12))) for i in range(2000)]
    rare = [(c, t + " vermin" if c and i < 36 else t) for i, (c, t) in enumerate(texts)]  # 18 of 1,000 toxic texts
    words, weights, line, classes = learnt(spark, rare)
    assert sum(classes) == 1000 and len(classes) == 2000
    assert features("vermin")[0] in weights and Scorer(words, weights, line).total("you verm1n")[1] == ["vermin"]
    assert not set(learnt(spark, texts)[1]) & set(features("vermin"))
    assert learnt(spark, [(1, "a b c d")]) is None


def test_toxicity_is_learned_from_all_labelled_texts(spark):
    r = random.Random(3)
    ids = [i for i in range(15_500) if not held(i, 5, 0)]
    rows = [(i, f"{word(r, 'aa')} {word(r, 'bb')} x{i} " + ("vermin" if k % 2 and k < 48 else "lamp"), k % 2) for k, i in enumerate(ids)]  # 24 of about 6,200 toxic texts: too few in any 2,000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(90_000, "you verm1n")], "doc_id long, text string")
    got = score_toxicity(docs, spark.createDataFrame([(i, c) for i, _, c in rows], "doc_id long, toxic int"))
    assert got.where("doc_id = 90000").first().words == ["vermin"] and got.count() == len(rows) + 1


def test_labelled_rows_are_all_met(spark):
    docs = spark.createDataFrame([(i // 2, f"t{i}") for i in range(20_000)] + [(None, "none")], "doc_id long, text string")
    marks = [(i, c) for i in range(0, 10_000, 3) for c in ([0, 1] if i % 2 else [1])] + [(99_999, 1), (None, 1)]
    got = all_labelled_rows(docs, spark.createDataFrame(marks, "doc_id long, class int"))
    assert sorted(map(tuple, got.collect())) == sorted((c, f"t{j}") for i, c in marks[:-2] for j in (2 * i, 2 * i + 1))
    assert all_labelled_rows(docs, spark.createDataFrame([], "doc_id long, class int")).count() == 0


def test_known_words_are_a_trie():
    r = random.Random(6)
    own = {"".join(r.choices("abéß字𝔞", k=r.randint(1, 6))): r.randint(1, 99) for _ in range(500)}
    words = Words.of(own)
    assert list(words) == sorted(own) and all(words[w] == n for w, n in own.items()) and "zz" not in words and "" not in words
    for _ in range(2000):
        text = "".join(r.choices("abéß字𝔞", k=r.randint(1, 6)))
        node = words.walk(text)
        assert bool(node) == any(w.startswith(text) for w in own) and (words.count(node) if node else 0) == own.get(text, 0) == words.get(text)
    assert Words.of({}).walk("a") == () and "a" not in Words.of({})


def test_chance_is_the_binomial_tail():
    for b, m, p in ((4, 4, 0.1), (3, 9, 0.3), (20, 25, 0.5)):
        assert chance(b, m, p) == pytest.approx(sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(b, m + 1)), rel=1e-6)
    assert chance(400_000, 500_000, 0.1) == 0.0


def test_near_copies_are_learned_from_once_and_like_beginnings_do_not_matter(spark):
    r = random.Random(9)
    base = [word(r, "aa") for _ in range(60)]
    copies = [(1, " ".join([*base, f"w{i}"])) for i in range(20)]
    halves = [(1, " ".join(base[:15] + [word(r, "cc") for _ in range(60)])) for _ in range(20)]  # share shingles, not near
    got = learnt(spark, copies + halves + [(0, "the only clean one")])
    assert 21 <= sum(got[3]) <= 23  # a copy whose own shingle is its smallest is not met


def brute(c, token):
    """Every reading of a token, letter by letter."""
    paths, last, run = [("", 0.0, 0.0)], "", 0
    for x in token:
        run = run + 1 if x == last else 1
        last = x
        paths = [(t + y, s + k + (c.step(("^^" + t)[-2:], y) if y else 0), k0 + k) for t, s, k0 in paths for y, k in c.options(x, run)]
    scores = {}
    for t, s, k in paths:
        own = max(s + c.step(("^^" + t)[-2:], "$"), k + math.log(c.words[t] / c.total) if t in c.words else -1e300)
        scores[t or token] = max(own, scores.get(t or token, -1e300))
    return scores


def test_decoding_is_exact():
    c = Channel({"rotten": 30, "scoundrel": 30, "the": 500, "cat": 50, "tore": 10, "note": 12, "idiot": 20, "ass": 9, "as": 100})
    r = random.Random(3)
    for _ in range(200):
        token = "".join(r.choices("abcrotensh013@$!.*+", k=r.randint(1, 7)))
        scores = brute(c, token)
        assert scores[c.restore(token)] == pytest.approx(max(scores.values()), abs=1e-9), token


def test_signs_at_the_end_are_decoded_once_for_like_beginnings(monkeypatch):
    r = random.Random(5)
    own = {"".join(r.choices(["ro", "te", "n", "idi", "ot", "as", "th", "e", "ca", "l", "i"], k=r.randint(1, 5))): r.randint(2, 99) for _ in range(600)}
    c = Channel(own)
    heads = [w for w in own if all(x != y for x, y in zip(w, w[1:]))] + ["xq", "zyx", "é"]
    for _ in range(300):
        head, signs = r.choice(heads)[: r.randint(1, 9)], "".join(r.choices("@$!|+*#%.,-", k=r.randint(1, 4)))
        scores, got = brute(c, head + signs), c.ended(head, signs)
        assert scores[got] == pytest.approx(max(scores.values()), abs=1e-9) and got == c.restore(signs, head), (head, signs)
    reader, steps = Scorer(own, {}, (1.0, 0.0)).reader, []
    monkeypatch.setattr(Words, "step", lambda self, *a, step=Words.step: steps.append(a) or step(self, *a))
    read = [reader.word(h + "***") for h in heads]
    assert len(steps) < 3 * len(heads)  # beginnings are met as wholes, not letter by letter, which took 4435 steps for 355
    assert read == [c.restore("***", h) for h in heads]


def test_single_characters_in_a_row_are_found():
    r, pattern = random.Random(2), re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
    for _ in range(2000):
        text = "".join(r.choices(["a", "é", "5", "bb", " ", "\n", "\u3000 ", "\x1c"], [3, 1, 1, 1, 5, 1, 1, 1], k=r.randint(0, 25)))
        tokens = text.split()
        assert list(spaced(tokens, [len(w) for w in tokens])) == [re.sub(r"\s", "", m.group()) for m in pattern.finditer(text)], text


def test_pieces_of_words_are_met_as_in_a_plain_search():
    r, long = random.Random(7), "abcde" * 14
    words = {"idiot": 30, "moron": 30, "id": 5, "it": 90, "mor": 4, "on": 80, long: 9, "ab": 4}
    targets = ["idiot", "moron", long]
    s = Scorer(words, {f: 1.0 for w in targets for f in features(w)[:1]}, (1.0, 0.0), targets)
    met = 0
    for _ in range(1500):
        tokens = [x for _ in range(4) for x in r.choice((["idi", "ot"], ["i", "diot"], ["id", "i", "ot."], ["mor", "on,!"], ["m", "or", "on"], [long[:40], long[40:]], [long[:66], long[66:]], [long[:20], long[20:65], long[65:] + "!"], ["mo", "-", "ron"], ["idi$", "ot"], ["it", "ab"], ["x"]))]
        want = []
        for i in range(len(tokens)):
            for j in range(i + 2, len(tokens) + 1):
                before, whole = "".join(tokens[i : j - 1]), trimmed("".join(tokens[i:j]))
                if not any(t != before and t.startswith(before) for t in targets):
                    break
                parts = [x for x in (*tokens[i : j - 1], trimmed(tokens[j - 1])) if x]
                if whole in targets and s.channel.own(whole) - 3.5 * (j - i - 1) > sum(map(s.channel.own, parts)) and not any(p in targets for p in parts):
                    want.append((whole, 1.0))
        assert s.reader.chunks(tokens, [len(w) for w in tokens]) == want, tokens
        met += len(want)
    assert met > 1000


def test_long_tokens_take_time_in_proportion():
    words = {"rotten": 30, "the": 500, "idiot": 20}
    s = Scorer(words, {f: 1.0 for f in features("idiot")}, (1.0, 0.0))
    r = random.Random(1)
    tokens = ["chapter" + "." * 10_000 + "7", "a" + "." * 10_000 + "b", "!" * 10_000 + "a", "a*" * 5_000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=100_000)), "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))]
    s.total("warm up")
    for token in tokens:
        began = time.process_time()
        assert s.total(token)[1] == []
        assert time.process_time() - began < 10, token[:20]
    assert "idiot" in s.total(" ".join("idiot" * 2000))[1]  # and the whole run, by its beginning
    assert [trimmed(x) for x in ("the!!", "(idio+).", "a$$", "a$", "...", "x...7", "b!$!")] == ["the", "(idio+", "a", "a$", "", "x...7", "b!$"]


def plain(e, trans, first):
    a, like = first * e[0], 0.0
    for t in range(len(e)):
        if t:
            a = (a @ trans) * e[t]
        like += math.log(a.sum())
        a = a / a.sum()
    return like


def test_recursions_equal_plain_ones():
    r = np.random.default_rng(1)
    sizes = np.array([7, 1, 12, 3])
    starts = np.cumsum(sizes) - sizes
    e, trans, first = r.random((23, 3)) + 0.01, r.random((3, 3)), r.random(3)
    by = longest_first(sizes)
    like = forward(e, starts[by], sizes[by], trans, first)
    gamma, moves, like2 = forward_backward(e, starts[by], sizes[by], trans, first)
    want = [plain(e[starts[i] : starts[i] + sizes[i]], trans, first) for i in by]
    assert np.allclose(like, want) and np.allclose(like2, want) and np.allclose(gamma.sum(axis=1), 1)
    assert np.isclose(moves.sum(), (sizes - 1).sum())
    h = 1e-6  # the expected transitions are the derivative of the likelihood by the log transitions
    bumped = trans.copy()
    bumped[1, 2] *= math.exp(h)
    assert np.isclose((forward(e, starts[by], sizes[by], bumped, first).sum() - like.sum()) / h, moves[1, 2], rtol=1e-3)


def test_scores(spark, corpus):
    docs, _ = frames(spark, corpus)
    got = {r.doc_id: r for r in score_texts(docs, symbols=60, states=4, sample=100).collect()}
    counts = collections.Counter()
    tokens = {i: [w for w in (t or "").encode().lower().split()] + [b"\n"] for i, t, *_ in corpus}
    for i, ws in tokens.items():
        if not held(i, 5, 1):
            counts.update(ws)
    N, V = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in counts for w in ws), N, held(i, 5, 1))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (N + 0.5 * (V + 1))) for w in ws), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert score_texts(docs.where("false")).count() == 0


def test_scores_are_probabilities_of_texts(spark):
    docs = spark.createDataFrame([(0, "a b"), (2, "b"), (3, "a a c"), (4, None)], "doc_id long, text string")
    learnt = [i for i in (0, 2, 3, 4) if not held(i, 5, 1)]
    words = sorted({w for i, t in ((0, "a b"), (2, "b"), (3, "a a c")) if i in learnt for w in t.split()})
    probe = [" ".join(p) for n in range(3) for p in __import__("itertools").product([*words], repeat=n)]
    rows = [(i, t) for i, t in ((0, "a b"), (2, "b"), (3, "a a c"), (4, None))] + [(j, p) for j, p in zip((k for k in range(10, 10_000) if held(k, 5, 1)), probe)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), states=2, symbols=2).where("doc_id >= 10").collect()
    assert docs.count() == 4 and 0 < sum(10**r.score for r in got) < 1
