"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network.

Every word has a sparse random index vector, fixed by its hash. In the learning texts a word's context vector is the
sum of the index vectors of its neighbours. Tokens are the frequent learning words, by context vector, and for every
other word the index vector of its shape (runs of letters, digits and marks); repeats of a word within a text are
tokens too. A document is the mean of its tokens' vectors and of their kinds, so no word order or length is lost to
a cut: whole texts are pooled. Two dense layers give a logit, and a temperature fitted on learning rows that the
network did not see turns it into a probability.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, fold, free_name, groups, lean, mix64, word_hashes, words_of
from .sampling import labelled_rows, prior_shift

DIM, SHAPES, REPEATS, ONES = 96, 4096, 6, 8
PART = 2_000 * DIM  # of the words' sums, in a message
MOST_WORDS = 100_000  # of a task's word cache; a full cache is emptied, results do not depend on it
_UPPER, _LOWER, _DIGIT, _OTHER = (re.compile(p) for p in (rb"[A-Z]+", rb"[a-z\x80-\xff]+", rb"[0-9]+", rb"([^A-Za-z0-9\x80-\xff])\1+"))


def shape(word: bytes) -> bytes:
    """Runs of upper-case, lower-case and digits as one sign each; other signs as they are, once."""
    w = _DIGIT.sub(b"\x01", word)
    w = _UPPER.sub(b"\x02", w)
    w = _LOWER.sub(b"\x03", w)
    return _OTHER.sub(rb"\1", w)


def index_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, ONES) places and signs of 64-bit keys: one random sign in each of ONES runs of dimensions."""
    h = mix64(keys.astype(U64)[:, None] * U64(0x9E3779B97F4A7C15) + np.arange(1, ONES + 1, dtype=U64))
    width = DIM // ONES
    return (np.arange(ONES) * width + (h >> U64(8)).astype(np.int64) % width).astype(np.int64), 1 - 2 * (h & U64(1)).astype(np.int64)


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """The sparse signs as unit vectors."""
    places, signs = index_places(keys)
    out = np.zeros((len(keys), DIM), np.float32)
    np.put_along_axis(out, places, signs.astype(np.float32), axis=1)
    return out / np.float32(ONES**0.5)


class Pool:
    """Texts to document vectors under a vocabulary of context vectors."""

    def __init__(self, vocabulary: np.ndarray, context: np.ndarray):
        self.known = {h: i for i, h in enumerate(vocabulary.tolist())}  # by hash of the lower-case word
        self.n = len(vocabulary)
        self.table = np.concatenate([context, index_vectors(np.arange(SHAPES + REPEATS))])
        self.cache: dict[bytes, tuple[int, int]] = {}

    def _places(self, word: bytes) -> tuple[int, int]:
        by_shape = self.n + xxhash.xxh3_64_intdigest(shape(word)) % SHAPES
        return self.known.get(xxhash.xxh3_64_intdigest(word.lower()), by_shape), by_shape

    def pool(self, texts: list[bytes | None]) -> np.ndarray:
        """(n, 3 * DIM): means over words, over their shapes, over repeats; zeros for an empty text."""
        out = np.zeros((len(texts), 3 * DIM), np.float32)
        at = 0
        while at < len(texts):  # about a quarter of a megabyte at a time
            start, size = at, 0
            while at < len(texts) and size < 250_000:
                size += len(texts[at] or b"")
                at += 1
            out[start:at] = self._pool(texts[start:at])
        return out

    def _pool(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), 3 * DIM), np.float32)
        words = [x.split() if x else [] for x in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if not flat:
            return out
        cache = self.cache
        if len(cache) > MOST_WORDS:
            cache.clear()
        for w in set(flat):
            if w not in cache:
                cache[w] = self._places(w)
        places = np.array([cache[w] for w in flat], np.int64)
        owner = np.repeat(np.arange(len(texts)), size)
        width = len(self.table)
        for k in (0, 1):  # mean of table rows, by each text's distinct tokens
            pair, count = np.unique(owner * width + places[:, k], return_counts=True)
            o, p = np.divmod(pair, width)
            weighted = self.table[p]
            weighted *= (count / size[o])[:, None].astype(np.float32)
            at = np.searchsorted(o, np.flatnonzero(size))
            out[np.flatnonzero(size), k * DIM : (k + 1) * DIM] = np.add.reduceat(weighted, at, axis=0)
        for i, ws in enumerate(words):  # how often the text repeats its words, and repeats them at once
            if ws:
                counts = np.fromiter(_tally(ws).values(), np.int64)
                level = np.bincount(np.minimum(REPEATS - 2, np.log2(counts * 100 / len(ws) + 1).astype(int)), counts, REPEATS) / len(ws)
                level[-1] = sum(map(eq, ws, ws[1:])) / len(ws)
                out[i, 2 * DIM :] = level @ self.table[-REPEATS:] * 3
        return out


def _tally(words: list[bytes]) -> dict[bytes, int]:
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return counts


@lean
def _word_counts(batches):
    """Hashes and counts of a task's lower-case words."""
    for batch in batches:
        h = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(words_of(x.as_py())) for x in batch.column("text"))])
        keys, n = np.unique(h, return_counts=True)
        yield pa.record_batch({"word": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def _neighbours(shared, near: int):
    """For each word of the vocabulary that a task's texts hold: the sum of its neighbours' index vectors."""

    @lean
    def run(batches):
        vocabulary = shared.value
        places, signs = index_places(vocabulary)
        sums = np.zeros(len(vocabulary) * DIM, np.int32)  # whole numbers, so the order of addition cannot matter
        for batch in batches:
            at, left, right = 0, [], []
            for i, x in enumerate(batch.column("text")):
                hs = word_hashes(words_of(x.as_py()))
                where = np.minimum(np.searchsorted(vocabulary, hs), len(vocabulary) - 1)
                ids = np.where(vocabulary[where] == hs, where, -1)
                for d in range(1, near + 1):
                    a, b = ids[:-d], ids[d:]
                    both = (a >= 0) & (b >= 0)
                    left += [a[both], b[both]]
                    right += [b[both], a[both]]
                at += len(ids)
                if at > 50_000 or i + 1 == batch.num_rows:
                    x, y = np.concatenate(left), np.concatenate(right)
                    for k in range(0, len(x), 100_000):
                        cell = x[k : k + 100_000, None] * DIM + places[y[k : k + 100_000]]
                        np.add.at(sums, cell.ravel(), signs[y[k : k + 100_000]].ravel().astype(np.int32))
                    at, left, right = 0, [], []
        for start in range(0, len(sums), PART):
            yield pa.record_batch({"start": pa.array([start], pa.int64()), "sums": pa.array([sums[start : start + PART].tobytes()], pa.binary())})

    return run


@lean
def _added(batches):
    """The sums of the tasks' parts."""
    for t in groups(batches, ["start"]):
        total = sum(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in t.column("sums"))
        yield pa.record_batch({"start": t.column("start").slice(0, 1).combine_chunks(), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def context_vectors(texts: DataFrame, most: int, least: int = 3, near: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``most`` frequent words that the learning texts hold ``least`` times, and the normed sums of their neighbours' index vectors.

    Counts and sums are made by the executors; the driver gets a count for each word and a vector for each taken.
    """
    counts = texts.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    words, n = counts.column("word").to_numpy().view(U64), counts.column("n").to_numpy()
    vocabulary = np.sort(words[np.lexsort((words, -n))][:most])
    if not len(vocabulary):
        return vocabulary, np.zeros((0, DIM), np.float32)
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    parts = texts.select("text").mapInArrow(_neighbours(shared, near), "start long, sums binary").repartition("start").sortWithinPartitions("start").mapInArrow(_added, "start long, sums binary")
    found = parts.toArrow().sort_by("start")
    shared.destroy()
    sums = np.frombuffer(b"".join(found.column("sums").to_pylist()), np.float32).reshape(-1, DIM)
    context = index_vectors(vocabulary) * np.float32(ONES**0.5) + sums  # a word is its own neighbour once
    return vocabulary, context / np.maximum(1e-6, np.linalg.norm(context, axis=1, keepdims=True))


def _pooled(shared):
    @lean
    def run(batches):
        pool = Pool(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = pool.pool([t.as_py() for t in part.column("text")])
                yield pa.record_batch({"class": part.column("class"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Net:
    """Two dense layers with a ReLU between, fitted by Adam with the word block dropped at times; the logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 800, seed: int = 3, drop: float = 0.8):
        r = np.random.default_rng(seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-4
        z = (x - self.mean) / self.std
        held = r.random(len(y)) < 0.2
        if held.all() or not held.any() or len(set(y[~held])) < 2:
            held[:] = False
        fit = ~held
        p = [r.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), r.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        rows = np.flatnonzero(fit)
        for step in range(1, steps + 1):
            at = r.choice(rows, min(512, len(rows)), replace=False)
            seen = z[at].copy()
            seen[r.random(len(at)) < drop, :DIM] = 0  # the words themselves are left out at times, so that form counts
            h = np.maximum(0, seen @ p[0] + p[1])
            miss = (sigmoid(h @ p[2] + p[3]) - y[at]) / len(at)
            back = np.outer(miss, p[2]) * (h > 0)
            for i, g in enumerate((seen.T @ back + 2e-3 * p[0], back.sum(axis=0), h.T @ miss + 1e-3 * p[2], np.array([miss.sum()]))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            logit, grid = self.logit(x[held]), np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [-np.mean(np.log(np.where(y[held] == 1, sigmoid(logit / t), sigmoid(-logit / t)) + 1e-12)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.maximum(0, z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray, shift: float = 0.0) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature + shift)


def _scores(batches, shared, constant: float, text: str):
    """(batch, scores) of pieces of the batches."""
    model = shared.value if shared else None
    pool = Pool(model[0], model[1]) if model else None
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            start, texts, size = at, [], 0
            while at < batch.num_rows and size < 5_000_000:
                texts.append(batch.column(text)[at].as_py())
                size += len(texts[-1] or b"")
                at += 1
            yield batch.slice(start, at - start), model[2].score(pool.pool(texts), model[3]) if model else np.full(len(texts), constant)


def _predict(fitted, cut: float):
    @lean
    def run(batches):
        for batch, s in _scores(batches, *fitted, "text"):
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s.astype(float)), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def _accept(fitted, cut: float, text: str):
    @lean
    def run(batches):
        for batch, s in _scores(batches, *fitted, text):
            yield batch.filter(pa.array(s >= cut)).drop_columns([text])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, out_fold: int = 0, per_class: int = 2000, most_words: int = 20_000) -> tuple:
    """(model as a broadcast, or None; the score without a model), from a bounded sample outside the held-out fold.

    Words are counted and texts pooled by the executors, over a scratch table of the sample; the driver fits the net
    on one vector of 3 * DIM numbers a text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("class")).where("class in (0, 1)").where(fold("doc_id", folds) != out_fold).distinct()
    sample = labelled_rows(d, marks, per_class, scratch, "sample")
    vocabulary, context = context_vectors(sample, most_words)
    shared = spark.sparkContext.broadcast((vocabulary, context))
    rows = sample.mapInArrow(_pooled(shared), "class int, x binary").toArrow()
    shared.destroy()
    scratch.close()
    rows = rows.sort_by([("class", "ascending"), ("x", "ascending")])  # any layout gives one order
    y = rows.column("class").to_numpy().astype(float)
    if len(set(y)) < 2:
        return None, float(y.mean()) if len(y) else 0.5
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(y), 3 * DIM)
    del rows
    return spark.sparkContext.broadcast((vocabulary, context, Net(x, y), prior_shift(marks, y.astype(int).tolist()))), 0.5


def classify(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, out_fold: int = 0, cut: float = 0.3, per_class: int = 2000, most_words: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= cut).

    Fitted on at most ``per_class`` labelled texts of each class, by the lowest hash of id and text, outside the
    held-out fold; of their words, the ``most_words`` most frequent have context vectors, all others count by their
    shape. Then every whole text is scored. Null and empty texts are a document without tokens and get that
    document's score. With labels of one class only, or none, the score is that class, or one half; an empty table
    gives an empty result. Null labels are not used; an id with several labels is learned with each. A text that
    stands under several ids is a learning row under each of them, equal rows are one. Repeated and null ids keep
    their rows; other columns are ignored.
    """
    fitted = fit(docs, labels, label_col=label_col, id_col=id_col, text_col=text_col, folds=folds, out_fold=out_fold, per_class=per_class, most_words=most_words)
    d = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, folds) == out_fold).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return d.mapInArrow(_predict(fitted, cut), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", cut: float = 0.3, **options) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at ``cut`` or above; each row by its own text."""
    fitted = fit(docs, labels, text_col=text_col, **options)
    name = free_name(docs, "text_bytes")
    return docs.withColumn(name, F.col(text_col).cast("binary")).mapInArrow(_accept(fitted, cut, name), docs.schema)
