"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its byte n-grams with boundary marks (those that touch a boundary are its affixes) and, if the
word is in the lexicon of the learning texts, the word itself. Weights are hashed into a fixed table. Learned
transitions label words of code-switched texts; the marginals come from the forward-backward recursion, which runs
over many texts at once, longest first, so that step t works on all texts that have a word t.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import forward_backward, longest_first
from .common import U64, Scratch, fold, mix64, word_hashes, words_of
from .sampling import learning_rows

BUCKETS = 1 << 15
MOST_WORDS = 200_000  # of a task's word cache; a full cache is emptied, results do not depend on it


def has_letter(word: bytes) -> bool:
    """Whether a word has a character of Unicode category L."""
    text = word.decode("utf-8", "replace")
    return text.isalpha() or any(map(str.isalpha, text))


def features(words: list[bytes], lexicon: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, concatenated, and the start of each word's run (never empty)."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(U64)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    ids, owners = [], []
    for n in (2, 3, 4):
        if len(raw) < n:
            continue
        at = np.flatnonzero(np.arange(len(raw)) + n <= end)
        h = np.full(len(at), n, U64)
        for j in range(n):
            h = mix64(h * U64(0x100000001B3) + raw[at + j])
        ids.append((h % U64(BUCKETS)).astype(np.int64))
        owners.append(owner[at])
    known = [(i, h) for i, h in enumerate(map(xxhash.xxh3_64_intdigest, words)) if h in lexicon]
    ids.append(np.array([h % BUCKETS for _, h in known], np.int64))
    owners.append(np.array([i for i, _ in known], np.int64))
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.searchsorted(owners[order], np.arange(len(words)))


def scaled(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0))


def _coded(batches):
    """Learning texts as the hashes of their words with letters."""
    for batch in batches:
        lists = [word_hashes([w for w in words_of(x.as_py()) if has_letter(w)]) for x in batch.column("text")]
        yield pa.record_batch({"class": batch.column("class"), "words": pa.array([h.tobytes() for h in lists], pa.binary())})


def _vocabulary(batches):
    """Words with letters and their counts."""
    for batch in batches:
        counts: dict[bytes, int] = {}
        for x in batch.column("text"):
            for w in words_of(x.as_py()):
                counts[w] = counts.get(w, 0) + 1
        counts = {w: n for w, n in counts.items() if has_letter(w)}
        yield pa.record_batch({"word": pa.array(counts, pa.binary()), "n": pa.array(counts.values(), pa.int64())})


def train(samples: list[tuple[str, np.ndarray]], vocab: list[bytes], often: list[int], *, length: int = 40, batch: int = 12_000, steps: int = 120, seed: int = 7) -> dict:
    """Weights, transitions, labels and lexicon from samples (language, hashes of a text's words) and their words with counts.

    Adam on the exact log-likelihood. Every word of every sample is learned from: texts are cut into pieces of 8 to
    ``length`` words, one to three pieces of any languages form a sequence, and each step takes the next sequences of
    about ``batch`` words, in an order drawn anew for each pass. There are ``steps`` steps, or as many as one pass
    over all sequences needs. The lexicon is the words that the samples hold twice.
    """
    rng = np.random.default_rng(seed)
    labels = sorted({x for x, _ in samples})
    number = {x: i for i, x in enumerate(labels)}
    if not sum(len(h) for _, h in samples):
        return {"labels": []}
    names = word_hashes(vocab)
    by = np.argsort(names)
    lexicon = {int(h) for h, n in zip(names, often, strict=True) if n > 1}
    ids, start = features(vocab, lexicon)
    end = np.append(start[1:], len(ids))
    parts, owners, cuts = [], [], []
    for lang, h in samples:
        at = 0
        while at < len(h):
            cuts.append((at, min(len(h), at + int(rng.integers(8, length)))))
            parts.append(h[cuts[-1][0] : cuts[-1][1]])
            owners.append(number[lang])
            at = cuts[-1][1]
    order = rng.permutation(len(parts))  # pieces of different languages meet in one sequence
    sizes = np.array([len(parts[i]) for i in order])
    word = by[np.searchsorted(names[by], np.concatenate([parts[i] for i in order]))].astype(np.int32)
    gold = np.repeat(np.array(owners, np.int32)[order], sizes)
    del parts, cuts
    joins, at = [0], 0  # sequences, by their first piece
    while at < len(sizes):
        at += int(rng.integers(1, 4))
        joins.append(min(at, len(sizes)))
    offsets = np.concatenate([[0], np.cumsum(sizes)])[joins]
    L = len(labels)
    params = [np.zeros((BUCKETS, L)), np.zeros((L, L))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps = max(steps, -(-int(offsets[-1]) // batch))
    turn: list[int] = []
    for step in range(1, steps + 1):
        take, n = [], 0
        turn = turn or rng.permutation(len(offsets) - 1).tolist()
        while turn and n < batch:
            take.append(turn.pop())
            n += int(offsets[take[-1] + 1] - offsets[take[-1]])
        size = np.array([offsets[q + 1] - offsets[q] for q in take])
        place_of = np.concatenate([np.arange(offsets[q], offsets[q + 1]) for q in take])
        own, w = np.unique(word[place_of], return_inverse=True)  # the batch's words, and their places among them
        g = gold[place_of]
        width = end[own] - start[own]
        head = np.cumsum(width) - width
        flat = ids[np.repeat(start[own] - head, width) + np.arange(int(width.sum()))]
        owner = np.repeat(np.arange(len(own)), width)
        first = np.cumsum(size) - size
        begins = np.zeros(len(w), bool)
        begins[first] = True
        by = longest_first(size)
        pairs = np.zeros((L, L))
        np.add.at(pairs, (g[:-1][~begins[1:]], g[1:][~begins[1:]]), 1)
        emit = np.add.reduceat(params[0][flat], head, axis=0)
        gamma, expected, _ = forward_backward(scaled(emit)[w], first[by], size[by], np.exp(params[1]), np.full(L, 1 / L))
        gamma[np.arange(len(g)), g] -= 1
        miss = -np.stack([np.bincount(w, gamma[:, j], len(own)) for j in range(L)], axis=1)
        grads = [np.stack([np.bincount(flat, miss[owner, j], BUCKETS) for j in range(L)], axis=1), pairs - expected]
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, d in enumerate(grads):
            d = d / len(w) - 1e-6 * params[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.99 * v[i] + 0.01 * d * d
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return {"labels": labels, "weights": params[0].astype(np.float32), "trans": np.exp(params[1]).astype(np.float32), "lexicon": lexicon}


class Labeller:
    """Marginals of whole texts under a trained model."""

    def __init__(self, model: dict):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.empty((0, len(self.model["labels"])), np.float32)
        self.letters = np.empty(0, bool)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if len(self.place) + len(new) > MOST_WORDS and self.place:
            self._empty()
            new = list(dict.fromkeys(words))
        rows, letters = [self.table], [self.letters]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids, start = features(part, self.model["lexicon"])
            has = np.fromiter(map(has_letter, part), bool, len(part))
            scores = np.add.reduceat(self.model["weights"][ids], start, axis=0)
            rows.append(scaled(np.where(has[:, None], scores, 0)).astype(np.float32))
            letters.append(has)
        if new:
            self.place |= {w: i for i, w in enumerate(new, len(self.place))}
            self.table, self.letters = np.concatenate(rows), np.concatenate(letters)
        place = self.place
        return np.fromiter((place[w] for w in words), np.int64, len(words))

    def label(self, texts: list[bytes | None]) -> list[tuple[str, float, int, int]]:
        """For each text: language, mean marginal of it, words with letters, switches between their likeliest labels."""
        labels = self.model["labels"]
        out: list[tuple[str, float, int, int]] = [("und", 0.0, 0, 0)] * len(texts)
        split = [words_of(x) for x in texts]
        order = sorted((i for i, w in enumerate(split) if w), key=lambda i: -len(split[i]))
        if not order or not labels:
            return out
        word = self._numbers([w for i in order for w in split[i]])
        sizes = np.array([len(split[i]) for i in order])
        starts = np.cumsum(sizes) - sizes
        gamma, _, _ = forward_backward(self.table[word], starts, sizes, self.model["trans"], np.full(len(labels), 1 / len(labels), np.float32))
        weight = self.letters[word]
        owner = np.repeat(np.arange(len(order)), sizes)
        n = np.bincount(owner, weight, len(order)).astype(int)
        sums = np.stack([np.bincount(owner, gamma[:, j] * weight, len(order)) for j in range(len(labels))], axis=1)
        o, best = owner[weight], gamma[weight].argmax(axis=1)
        changed = np.bincount(o[1:][(o[1:] == o[:-1]) & (best[1:] != best[:-1])], minlength=len(order)) if len(o) else np.zeros(len(order), int)
        for k, i in enumerate(order):
            if n[k]:
                j = int(sums[k].argmax())
                out[i] = (labels[j], float(min(1.0, max(0.0, sums[k, j] / n[k]))), int(n[k]), int(changed[k]))
        return out


def _predict(shared, tokens: int = 1_500_000):
    def run(batches):
        labeller = Labeller(shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, start = [], 0, at
                while at < batch.num_rows and size < 6 * tokens:
                    texts.append(batch.column("text")[at].as_py())
                    size += len(texts[-1] or b"")
                    at += 1
                found = labeller.label(texts)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(start, at - start),
                        "held_out": batch.column("held_out").slice(start, at - start),
                        "lang_pred": pa.array([x[0] for x in found], pa.string()),
                        "score": pa.array([x[1] for x in found], pa.float64()),
                        "n_words": pa.array([x[2] for x in found], pa.int64()),
                        "n_switches": pa.array([x[3] for x in found], pa.int64()),
                    }
                )

    return run


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, out_fold: int = 2, per_language: int = 250) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_words (with letters), n_switches.

    The model is fitted on at most ``per_language`` whole texts of every non-null value of lang, taken by the lowest
    hash of id and text, outside the held-out fold; it then labels every whole text. A null text or one without a
    letter (Unicode category L) is ``und`` with score 0; so is everything if there is nothing to learn from. Ties go to
    the first language in order. Of repeated ids each row is learned with its own lang, of equal rows one. Repeated and
    null ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.withColumn("held_out", fold("doc_id", folds) == out_fold)
    rows = learning_rows(d.where("not held_out and text is not null").select("doc_id", "text", F.col("lang").alias("class")), per_language, scratch, "sample", "doc_id")
    coded = rows.mapInArrow(_coded, "class string, words binary").toArrow().sort_by([("class", "ascending"), ("words", "ascending")])  # any layout gives one order
    vocab = rows.mapInArrow(_vocabulary, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow().sort_by("word")
    scratch.close()
    samples = [(c, np.frombuffer(h, U64)) for c, h in zip(coded.column("class").to_pylist(), coded.column("words").to_pylist(), strict=True)]
    shared = spark.sparkContext.broadcast(train(samples, vocab.column("word").to_pylist(), vocab.column("n").to_pylist()))
    return d.select("doc_id", "held_out", "text").mapInArrow(_predict(shared), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_words long, n_switches long")
