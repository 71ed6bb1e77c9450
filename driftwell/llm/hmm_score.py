"""Hidden Markov language model: Baum-Welch over the whole corpus, exact likelihood by the scaled forward recursion.

Every learning word has emissions of its own, whatever the size of the vocabulary. Those of the ``symbols`` most
frequent words are a bounded table that every executor holds; all rounds of Baum-Welch refine it, together with the
transitions and one shared symbol for all other words. The last round also adds up, for each of the other words, how
often each state is expected to have emitted it; words with ``least`` uses keep those counts of their own, leaning on
the corpus shares, and rarer and unseen ones share what is left. These emissions stay a table keyed by word. Texts
are encoded in blocks; a block's distinct words meet that table in a join, what comes back is packed by block, and the
block is scored with it.

Each round reads the encoded corpus, adds up expected counts within partitions, and sums them across partitions. For
learning, long texts are cut into runs of ``run`` words; scores always follow the whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.scratch import finished_shuffles_deleted

from .chains import backward_steps, by_step, forward, forward_steps, longest_first
from .common import U64, Scratch, fold, groups, lean, word_hashes, words_of
from .sampling import share_of

END = b"\n"  # no word holds a line feed
PIECE = 6_000_000  # bytes of text, or half as many symbols, worked on at once
BLOCK = 16_000_000  # bytes of text whose words are looked up together
FINE, UNIT = 2048.0, 64.0  # expected counts of words are kept as round(FINE * ln(1 + UNIT * count)), 16 bits each
HELD = 500_000  # words that are packed by block at once
USE, MOST = 2048, 65_535  # steps of one use, and of a row; whole steps travel, so that sums do not depend on the order of addition


def _pieces(batch, column: str, most: int):
    """(start, values) of consecutive rows with about ``most`` bytes."""
    at = 0
    while at < batch.num_rows:
        start, got, size = at, [], 0
        while at < batch.num_rows and size < most:
            got.append(batch.column(column)[at].as_py())
            size += len(got[-1] or b"")
            at += 1
        yield start, got


@lean
def _count(batches):
    counts: dict[bytes, int] = {}

    def rows():
        words, n = list(counts), list(counts.values())
        return pa.record_batch({"word": pa.array(word_hashes(words).view(np.int64)), "n": pa.array(n, pa.int64())})

    for batch in batches:
        for x in batch.column("text"):
            words = words_of(x.as_py())
            words.append(END)
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            if len(counts) > 400_000:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


CODED = "block long, role int, doc_id {kind}, held_out boolean, ids binary, rare binary"


def _encode(keys: np.ndarray):
    """Blocks of texts as symbols; keys: sorted hashes of the frequent words. Role 1 is a text: its symbols, and the
    hashes of its other words in order. Role 0 are a block's distinct other words."""
    other = len(keys)

    @lean
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, texts in _pieces(batch, "text", BLOCK):
                n, coded, missing, rare = len(texts), [], [], [np.zeros(0, U64)]
                at = 0
                while at < n:  # about a megabyte of words at a time
                    split, size = [], 0
                    while at < n and size < 1_000_000:
                        split.append(words_of(texts[at]))
                        size += len(texts[at] or b"")
                        texts[at] = None
                        at += 1
                    h = word_hashes([w for words in split for w in words])
                    place = np.minimum(np.searchsorted(keys, h), max(0, other - 1))
                    hit = keys[place] == h if other else np.zeros(len(h), bool)
                    ids = np.where(hit, place, other).astype(np.uint16)
                    ends = np.cumsum([len(w) for w in split])
                    lost = np.concatenate([[0], np.cumsum(~hit)])[np.concatenate([[0], ends])]
                    coded += [ids[x:y].tobytes() for x, y in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
                    h = h[~hit]
                    missing += [h[x:y].tobytes() for x, y in zip(lost[:-1], lost[1:], strict=True)]
                    rare.append(np.unique(h))
                doc = batch.column("doc_id").slice(start, n)
                yield pa.record_batch(
                    {
                        "block": pa.array(np.full(n + 1, block)),
                        "role": pa.array(np.append(0, np.ones(n, int)).astype(np.int32)),
                        "doc_id": pa.concat_arrays([pa.nulls(1, doc.type), doc]),
                        "held_out": pa.concat_arrays([pa.nulls(1, pa.bool_()), batch.column("held_out").slice(start, n)]),
                        "ids": pa.array([None, *coded], pa.binary()),
                        "rare": pa.array([np.unique(np.concatenate(rare)).tobytes(), *missing], pa.binary()),
                    }
                )
                block += 1

    return run


def _hashes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


@lean
def _wanted(batches):
    """(block, word) of the blocks' distinct other words."""
    for batch in batches:
        for i, block in enumerate(batch.column("block").to_pylist()):
            h = _hashes(batch.column("rare").slice(i, 1))
            yield pa.record_batch({"block": pa.array(np.full(len(h), block)), "word": pa.array(h)})


def _symbols(blobs: list[bytes], end: int, cut: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with ends, and starts, sizes and first marks of the sequences, longest first; cut: most in a sequence."""
    lists = [np.append(np.frombuffer(b, np.uint16), np.uint16(end)) for b in blobs]
    size = np.array([len(x) for x in lists])
    start = np.cumsum(size) - size
    first = np.ones(len(size), bool)
    if cut:
        n = -(-size // cut)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, size, first = np.repeat(start, n) + part * cut, np.minimum(cut, np.repeat(size, n) - part * cut), part == 0
    by = longest_first(size)
    return np.concatenate(lists), start[by], size[by], first[by]


def expected_counts(symbols, start, size, first, model, other: int | None = None) -> tuple:
    """Expected emissions, transitions and starts, the natural log-likelihood, and the marginals of the symbol ``other`` in order."""
    emit, trans, begin, usual = model
    place, sequence, active = by_step(start, size)
    heads = np.where(first[:, None], begin, usual).astype(emit.dtype)
    dealt = symbols[place]
    e = emit[dealt]
    gamma, scale = forward_steps(e, active, trans, heads)
    moves = backward_steps(e, active, trans, gamma, scale)
    counts = np.stack([np.bincount(dealt, gamma[:, j], len(emit)) for j in range(emit.shape[1])], axis=1)
    begins = gamma[: len(start)][first].sum(axis=0, dtype=float)
    own = None
    if other is not None:
        hit = np.flatnonzero(dealt == other)
        own = gamma[hit[np.argsort(place[hit])]]
    return counts, moves, begins, float(np.log(scale, dtype=float).sum()), own


def new_model(e: np.ndarray, moves: np.ndarray, begin: np.ndarray, weight: float = 200.0) -> tuple:
    """Maximisation; emissions lean on the corpus shares, transitions and starts on even ones."""
    total = e.sum(axis=1) + 0.5
    emit = e + weight * (total / total.sum())[:, None]
    emit /= emit.sum(axis=0)
    usual = e.sum(axis=0) + 1
    return emit, (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), (begin + 1) / (begin + 1).sum(), usual / usual.sum()


def initial(blobs: list[bytes], symbols: int, states: int, run: int, seed: int = 11) -> tuple:
    """From a bounded sample: a mixture of word distributions over texts, then a few rounds of Baum-Welch on it."""
    rng = np.random.default_rng(seed)
    total = symbols + 2
    if not blobs:
        return new_model(np.ones((total, states)), np.eye(states) * 50, np.ones(states))
    lists = [np.frombuffer(b, np.uint16) for b in blobs]
    text, word = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
    overall = np.bincount(word, minlength=total)[:, None] / max(1, len(word)) + 1e-6
    gathered = lambda share: np.stack([np.bincount(word, share[text, j], total) for j in range(states)], axis=1)
    share = rng.dirichlet(np.ones(states) * 0.3, len(lists))
    for _ in range(15):
        logs = gathered(share) + 50 * overall
        logs = np.log(logs / logs.sum(axis=0))
        score = np.stack([np.bincount(text, logs[word, j], len(lists)) for j in range(states)], axis=1) * 0.1 + np.log(share.mean(axis=0) + 1e-3)
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    e = gathered(share)
    e[symbols + 1] += share.sum(axis=0)
    model = new_model(e, np.eye(states) * 20 * states + 1, share.sum(axis=0))
    seqs = _symbols(blobs, symbols + 1, run)
    for _ in range(5):
        model = new_model(*expected_counts(*seqs, (model[0].astype(np.float32), *model[1:]))[:3])
    return model


def packed(counts: np.ndarray) -> list[np.ndarray]:
    """Counts (n, states) as longs of four 16-bit steps each."""
    return _longs(np.minimum(np.rint(FINE * np.log1p(UNIT * counts)), MOST).astype(np.uint16))


def unpacked(longs: list[np.ndarray], states: int) -> np.ndarray:
    return _counts(_steps(longs, states))


def _counts(steps: np.ndarray) -> np.ndarray:
    return np.expm1(steps / FINE) / UNIT


def _longs(steps: np.ndarray) -> list[np.ndarray]:
    steps = np.pad(steps, ((0, 0), (0, -steps.shape[1] % 4)))
    return list(np.ascontiguousarray(steps).view(np.int64).T)


def _steps(longs: list[np.ndarray], states: int) -> np.ndarray:
    return np.ascontiguousarray(np.stack(longs, axis=1)).view(np.uint16)[:, :states]


def summed_uses(words: list[np.ndarray], uses: list[np.ndarray]) -> pa.RecordBatch:
    """The steps (16 bits, by state) of a word's uses added up; above MOST in several rows. Empties the lists."""
    keys, at = np.unique(np.concatenate(words), return_inverse=True)
    words.clear()
    sums = np.empty((len(keys), uses[0].shape[1]), np.int32)
    for j in range(sums.shape[1]):
        sums[:, j] = np.bincount(at, np.concatenate([u[:, j] for u in uses]), len(keys))
    uses.clear()
    many = sums.max(axis=1) > MOST
    rest, steps = sums[many], np.minimum(sums, MOST).astype(np.uint16)
    names, rows, own = [keys], [steps], keys[many]
    while len(own):
        rest = np.maximum(rest - MOST, 0)
        names.append(own)
        rows.append(np.minimum(rest, MOST).astype(np.uint16))
        left = rest.max(axis=1) > MOST
        rest, own = rest[left], own[left]
    return pa.record_batch({"word": pa.array(np.concatenate(names))} | {f"q{k}": pa.array(q) for k, q in enumerate(_longs(np.concatenate(rows)))})


def _expect(shared, end: int, cut: int, states: int):
    """A task's expected counts: a row for each symbol, state, and the starts."""

    @lean
    def run(batches):
        model, e, moves, begin, like = shared.value, 0, 0, 0, 0.0
        model = (model[0].astype(np.float32), *model[1:])
        for batch in batches:
            for _, blobs in _pieces(batch, "ids", PIECE // 6):
                got = expected_counts(*_symbols(blobs, end, cut), model)
                e, moves, begin, like = e + got[0], moves + got[1], begin + got[2], like + got[3]
        if np.ndim(e):
            used = np.flatnonzero(e.sum(axis=1) > 0)
            rows = np.concatenate([e[used], moves, [begin], [[like] * states]])
            symbol = np.concatenate([used, -1 - np.arange(states), [-states - 1, -states - 2]])
            yield pa.record_batch({"symbol": pa.array(symbol.astype(np.int32))} | {f"s{j}": pa.array(rows[:, j]) for j in range(states)})

    return run


def _expect_words(shared, end: int, cut: int, states: int):
    """How often each state is expected to have emitted a task's other words."""

    @lean
    def run(batches):
        model = shared.value
        model = (model[0].astype(np.float32), *model[1:])
        words, uses, held = [], [], 0
        for batch in batches:
            for start, blobs in _pieces(batch, "ids", PIECE // 6):
                own = expected_counts(*_symbols(blobs, end, cut), model, end - 1)[4]
                uses.append(np.rint(own * USE).astype(np.uint16))
                words.append(_hashes(batch.column("rare").slice(start, len(blobs))))
                held += len(own)
                if held > 1_000_000:
                    yield summed_uses(words, uses)
                    held = 0
        if held:
            yield summed_uses(words, uses)

    return run


def _added(states: int):
    """Rows of sorted words: the counts of one word added up."""

    @lean
    def run(batches):
        last, rest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word").to_numpy()
            counts = _steps([batch.column(f"q{k}").to_numpy() for k in range(-(-states // 4))], states).astype(np.int64)
            heads = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
            sums, keys = np.add.reduceat(counts, heads, axis=0), word[heads]
            if last is not None:
                if last == keys[0]:
                    sums[0] += rest
                else:
                    sums, keys = np.concatenate([[rest], sums]), np.append(last, keys)
            last, rest = keys[-1], sums[-1]
            if len(keys) > 1:
                yield pa.record_batch({"word": pa.array(keys[:-1])} | {f"q{k}": pa.array(q) for k, q in enumerate(packed(sums[:-1] / USE))})
        if last is not None:
            yield pa.record_batch({"word": pa.array([last], pa.int64())} | {f"q{k}": pa.array(q) for k, q in enumerate(packed(rest[None] / USE))})

    return run


def _high(states: int, least: int):
    """Uses, words and expected counts of a task's words that keep their own."""

    @lean
    def run(batches):
        n, v, total = 0, 0, np.zeros(states)
        for batch in batches:
            own = batch.column("q0").is_valid().to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(own))
            if part.num_rows:
                n, v = n + int(part.column("c").to_numpy().sum()), v + part.num_rows
                total += unpacked([part.column(f"q{k}").to_numpy() for k in range(-(-states // 4))], states).sum(axis=0)
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "v": pa.array([v], pa.int64())} | {f"s{j}": pa.array([total[j]]) for j in range(states)})

    return run


def by_block(batches: list[pa.RecordBatch], states: int) -> pa.RecordBatch:
    """One row for each block: hashes of its words (``rare``), first those with counts of their own, all their ``uses``, and
    those counts (``own``). Empties the list."""
    t = pa.Table.from_batches(batches)
    batches.clear()
    block, has = t.column("block").to_numpy(), t.column("q0").is_valid().to_numpy()
    by = np.lexsort((~has, block))
    block, has = block[by], has[by]
    words, uses = (t.column(c).to_numpy()[by] for c in ("word", "c"))
    steps = _steps([t.column(f"q{k}").take(pa.array(by[has])).to_numpy() for k in range(-(-states // 4))], states)
    cuts = np.append(np.append(0, np.flatnonzero(block[1:] != block[:-1]) + 1), len(block))
    owned = np.append(0, np.cumsum(has))[cuts]
    cut = lambda values, at: [values[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
    packed_up = lambda blobs: pa.array([zlib.compress(b, 1) for b in blobs], pa.binary())
    return pa.record_batch({"block": pa.array(block[cuts[:-1]]), "rare": pa.array(cut(words, cuts), pa.binary()), "uses": packed_up(cut(uses, cuts)), "own": packed_up(cut(steps, owned))})


def words_of_block(known: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From rows of by_block: the words, their uses, the places of those with counts of their own, and these counts."""
    words, uses, places, own, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, states), np.uint16)], 0
    for h, c, steps in zip(*(known.column(x).to_pylist() for x in ("rare", "uses", "own")), strict=True):
        words.append(np.frombuffer(h, np.int64))
        uses.append(np.frombuffer(zlib.decompress(c), np.int64))
        own.append(np.frombuffer(zlib.decompress(steps), np.uint16).reshape(-1, states))
        places.append(n + np.arange(len(own[-1])))
        n += len(words[-1])
    return np.concatenate(words), np.concatenate(uses), np.concatenate(places), _counts(np.concatenate(own))


def _by_block(states: int):
    @lean
    def run(batches):
        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield by_block(some, states)
                n = 0
        if n:
            yield by_block(some, states)

    return run


def _score(shared, end: int, states: int):
    """Blocks: their words with counts and emissions first, then their texts."""

    @lean
    def run(batches):
        emit, trans, begin, logs, ratio, whole = shared.value
        for t in groups(batches, ["block"]):
            known, texts = (t.filter(pc.equal(t.column("role"), role)) for role in (0, 1))
            keys, c, has, own = words_of_block(known, states)
            c = np.append(c.astype(float), 0.0)  # the last is any word that no learning text has
            share = _log_share(c, whole)
            times = np.tile(ratio["low"], (len(c), 1))
            times[has] = (own / 10 ** (share[has] - ratio["all"])[:, None] + ratio["weight"]) / (ratio["total"] + ratio["weight"])
            by = np.append(np.argsort(keys), len(keys))
            order_of = keys[by[:-1]]
            del t, known, own
            for batch in texts.to_batches():
                for start, blobs in _pieces(batch, "ids", PIECE // 8):
                    n = len(blobs)
                    lists = [np.append(np.frombuffer(b, np.uint16), np.uint16(end)) for b in blobs]
                    size = np.array([len(x) for x in lists])
                    symbols = np.concatenate(lists)
                    h = _hashes(batch.column("rare").slice(start, n))
                    at = np.searchsorted(order_of, h)
                    inside = np.flatnonzero(at < len(keys))
                    at[inside[order_of[at[inside]] != h[inside]]] = len(keys)
                    at = by[at]
                    rare = np.flatnonzero(symbols == end - 1)
                    e = emit[symbols]
                    e[rare] *= times[at]
                    owner = np.repeat(np.arange(n), size)
                    base = np.bincount(owner, logs[symbols], n) + np.bincount(owner[rare], share[at], n)
                    missed = np.bincount(owner[rare], c[at] == 0, n).astype(int) + int(not ratio["end_known"])
                    starts, order = np.cumsum(size) - size, longest_first(size)
                    like = np.empty(n)
                    like[order] = forward(e, starts[order], size[order], trans, begin) / np.log(10)
                    like += np.bincount(owner[rare], (share - ratio["all"])[at], n)
                    yield pa.record_batch(
                        [batch.column("doc_id").slice(start, n), batch.column("held_out").slice(start, n), pa.array(size, pa.int64()), pa.array(size - missed, pa.int64()), pa.array(base), pa.array(like)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                    )

    return run


def _log_share(c, whole: float):
    """Base log10 probability of a word with c uses."""
    return np.log10((c + 0.5) / whole)


def frequent_from(words: DataFrame, most: int) -> int:
    """The least count c for which at most ``most`` words have it or more; from a histogram over fixed log steps."""
    step = F.floor(F.ln("c") * 64).cast("int")
    found = 0
    least = None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).collect(), key=lambda r: -r["step"]):
        if found + r["n"] > most:
            return least if least is not None else r["high"] + 1
        found, least = found + r["n"], r["low"]
    return least if least is not None else 1


def _learned(d: DataFrame, scratch: Scratch, states: int, symbols: int, rounds: int, run: int, sample: int, least: int) -> tuple:
    """The encoded texts, the table of the other words, the model (broadcast), the symbol of the end, and N."""
    spark = d.sparkSession
    counts = scratch.table(d.where("not held_out").select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    N, V = total["n"], total["v"]

    whole = N + 0.5 * (V + 1)
    end_key = int(word_hashes([END]).view(np.int64)[0])
    ends = (counts.where(F.col("word") == end_key).first() or {"c": 0})["c"]
    words = counts.where(F.col("word") != end_key)
    often_enough = frequent_from(words, symbols)
    top = words.where(F.col("c") >= often_enough).toArrow()  # at most `symbols` rows
    keys = top.column("word").to_numpy().view(U64)
    by = np.argsort(keys)
    keys, often = keys[by], top.column("c").to_numpy()[by]
    coded = scratch.table(d.mapInArrow(_encode(keys), CODED.format(kind=d.schema["doc_id"].dataType.simpleString())), "coded")
    n, end = len(keys), len(keys) + 1
    learn = coded.where("role = 1 and not held_out").select("ids", "rare")

    # the start of the states
    hashed = coded.where("role = 1 and not held_out").select("ids", F.xxhash64("doc_id", "ids", "rare").alias("h"))
    distinct = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    few = hashed.where(share_of(F.col("h")) < 2 * sample / max(1, distinct)).groupBy("h").agg(F.first("ids").alias("ids"))  # about 2 * sample rows
    model = initial([bytes(r["ids"]) for r in few.orderBy("h").limit(sample).collect()], n, states, run)

    columns, steps = [f"s{j}" for j in range(states)], [f"q{k}" for k in range(-(-states // 4))]
    words_schema = "word long, " + ", ".join(f"{q} long" for q in steps)
    full = np.zeros((n + 2 + states + 2, states))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = learn.select("ids").mapInArrow(_expect(shared, end, run, states), "symbol int, " + ", ".join(f"{c} double" for c in columns)).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in columns))
        rows = part.toArrow()  # a row for each frequent word
        if not rows.num_rows:
            break
        full = np.zeros((n + 2 + states + 2, states))
        full[rows.column("symbol").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)  # negative symbols count from the end
        model = new_model(full[: n + 2], full[-states:][::-1], full[-states - 1])
        if k < rounds - 1:
            shared.destroy()

    # emissions of all other words: own counts of the last round from `least` uses on, and one share of the rest for rarer and unseen ones
    rest_n, rest_v = N - int(often.sum()) - ends, V - n - bool(ends)
    others = learn.mapInArrow(_expect_words(shared, end, run, states), words_schema).repartition("word").sortWithinPartitions("word").mapInArrow(_added(states), words_schema)
    own = F.col("c") >= least
    table = words.where(F.col("c") < often_enough).join(others, "word", "left").select("word", "c", *(F.when(own, F.col(q)).alias(q) for q in steps))
    table = scratch.table(table, "table")
    scratch.drop("counts")
    high = table.mapInArrow(_high(states, least), "n long, v long, " + ", ".join(f"{c} double" for c in columns)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", *columns))).first()
    mass = rest_n + 0.5 * (rest_v + 1)
    share = (rest_n - high["n"] + 0.5 * (rest_v - high["v"] + 1)) / mass
    kept = np.array([float(high[c]) for c in columns])
    weight, low = full[n] + 1, np.maximum(0, full[n] - kept)
    total_of = low + kept
    ratio = {"all": float(np.log10(mass / whole)), "total": total_of, "weight": weight, "low": (low / share + weight) / (total_of + weight), "end_known": bool(ends)}
    logs = np.concatenate([_log_share(often, whole), [0.0, float(_log_share(ends, whole))]])
    shared = spark.sparkContext.broadcast((*model[:3], logs, ratio, whole))
    return coded, table, shared, end, N


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, out_fold: int = 1, states: int = 8, symbols: int = 50_000, rounds: int = 3, run: int = 128, sample: int = 1500, least: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learning covers every text outside the held-out fold; ``sample`` bounds only the texts that start the states, those
    of the lowest hash of id and text, so that results do not depend on how the table is cut into files. ``symbols``
    bounds the words whose emissions all rounds refine; the others get theirs in the last round, if they have ``least``
    uses. A null text is empty: its one token is the end. Without learning texts every base term is log10(1) and the
    model is even. Repeated rows are learned as often as they stand; repeated and null ids keep their rows; other
    columns are ignored; an empty table gives an empty result.
    """
    if not 0 < symbols < 65_534 or rounds < 1:
        raise ValueError("symbols must fit 16 bits, and there must be a round")
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    d = d.withColumn("held_out", fold("doc_id", folds) == out_fold)
    with finished_shuffles_deleted(spark):
        coded, table, shared, end, N = _learned(d, scratch, states, symbols, rounds, run, sample, least)

    steps = [f"q{k}" for k in range(-(-states // 4))]
    none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
    wanted = coded.where("role = 0").select("block", "rare").mapInArrow(_wanted, "block long, word long").join(table, "word").select("block", "word", "c", *steps)
    wanted = wanted.mapInArrow(_by_block(states), "block long, rare binary, uses binary, own binary")
    wanted = wanted.select("block", F.lit(0).alias("role"), *none(("doc_id", kind), ("held_out", "boolean"), ("ids", "binary")), "rare", "uses", "own")
    texts = coded.where("role = 1").select("block", "role", "doc_id", "held_out", "ids", "rare", *none(("uses", "binary"), ("own", "binary")))
    out = wanted.union(texts).repartition("block").sortWithinPartitions("block", "role")
    out = out.mapInArrow(_score(shared, end, states), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(N)).cast("long").alias("train_tokens"), "base_score", "score")
