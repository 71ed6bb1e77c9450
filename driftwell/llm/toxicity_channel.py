"""Toxicity of restored text: a noisy channel undoes leetspeak, spacing and repetition before words are scored.

A suspicious token (signs or digits among or after its letters, a letter three times in a row, or letters set apart by
blanks) is a lattice: each sign may stand for some letters, be noise, or repeat the one before. Viterbi decoding finds
the likeliest letters under a character trigram model of the learning texts, over states of the last two letters; a
second pass over the trie of known words finds the likeliest known word, which has its own probability. Both are exact
and take time in proportion to the token. Plain tokens are read as they are. Whole texts are scored, by the distinct
restored words they hold and their beginnings, which words of one stem share.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold
from .minhash_dedup import shingle_set
from .quality_net import sigmoid
from .sampling import all_labelled_rows, prior_shift

# The letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "§": "s", "¡": "i",
    "*": "aeiou", "#": "h", "%": "x",
}
MOST_WORDS, MOST_IDLE, MOST_STEPS, MOST_LETTERS = 200_000, 400_000, 50_000, 64  # entries of a task's caches, and letters of a cached token; results do not depend on them
MOST_SPELLINGS, FEW = 200, 40  # of signs, and known words of one beginning, that are met one by one
BEYOND = 3.17e-5  # a chance beyond z = 4
APART = -3.0  # log probability that a spaced run goes on with letters of no known word
NONE = -1e300
_LEAD = re.compile(r"[^\w@$!|+(<{€£§¡*#%]*")  # what no letter hides behind at a token's start
_THRICE = re.compile(r"(.)\1\1")
_LONG = re.compile(r"(.)\1{3,}")
_DOUBLE = re.compile(r"(.)\1+")
_hash = xxhash.xxh3_64_intdigest
_PLAIN = re.compile(r"(?:([^\W\d_])(?!\1)){8,}")  # letters, none of them doubled


def trimmed(token: str) -> str:
    """A token without the signs around it; single signs at its end that may be letters stay, doubled ones go."""
    start, end = 0 if token[:1].isalpha() else _LEAD.match(token).end(), len(token)
    while end > start:
        c = token[end - 1]
        if c.isalnum() or c == "_":
            break
        run = end - 1
        while run > start and token[run - 1] == c:
            run -= 1
        if end - run > 1:
            end = run
        elif c in "@$|+€£§":
            break
        else:
            end -= 1
    return token[start:end]


def core_of(token: str) -> str:
    """A token without the signs around it that no letter hides behind."""
    start, end = 0 if token[:1].isalpha() else _LEAD.match(token).end(), len(token)
    while end > start and not (token[end - 1].isalnum() or token[end - 1] == "_" or token[end - 1] in LEET):
        end -= 1
    return token[start:end]


class Words:
    """Known words of letters and their counts, sorted, in buffers of about twenty bytes a word; and what they say of letters.

    A node of their trie is the span of words with a beginning: (first, end, bytes, letters); () is none, spans are bisected.
    """

    def __init__(self, letters: bytes, ends: bytes, counts: bytes, tri: dict[str, int]):
        """letters: the words in UTF-8, by code point; ends: offsets (int32), 0 first; counts: int64; tri: their trigrams' counts."""
        self.state = letters, ends, counts, tri
        self.letters, self.ends, self.counts, self.tri = letters, memoryview(ends).cast("i"), memoryview(counts).cast("q"), tri
        self.n = len(self.counts)
        self.total = int(np.frombuffer(counts, np.int64).sum()) + 1
        self.root = (0, self.n, 0, 0)
        self.seen: dict[tuple, tuple] = {}
        self.spans: dict[str, tuple] = {}

    def __reduce__(self):
        return Words, self.state

    @classmethod
    def of(cls, words: dict[str, int]) -> Words:
        own = sorted(w for w in words if w.isalpha())
        column = pa.array(own, pa.string())
        return cls.sorted(column, pa.array([words[w] for w in own], pa.int64()), trigrams(own, [words[w] for w in own]))

    @classmethod
    def sorted(cls, column: pa.Array, counts: pa.Array, tri: dict[str, int]) -> Words:
        """From sorted columns without nulls."""
        if not len(column):
            return cls(b"", bytes(4), b"", tri)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return cls(column.buffers()[2].to_pybytes()[ends[0] : ends[-1]], (ends - ends[0]).tobytes(), counts.to_numpy().tobytes(), tri)

    def __iter__(self):
        return (self.word(i) for i in range(self.n))

    def word(self, i: int) -> str:
        return self.letters[self.ends[i] : self.ends[i + 1]].decode()

    def get(self, word: str) -> int:
        """The word's count, or 0."""
        own, letters, ends = word.encode("utf-8", "replace"), self.letters, self.ends
        i = bisect_left(range(self.n), own, key=lambda i: letters[ends[i] : ends[i + 1]])
        return self.counts[i] if i < self.n and letters[ends[i] : ends[i + 1]] == own else 0

    def __contains__(self, word: str) -> bool:
        return self.get(word) > 0

    __getitem__ = get

    def step(self, node: tuple, letter: str) -> tuple:
        """The node after a letter."""
        got = self.seen.get((node, letter))
        if got is None:
            if len(self.seen) > MOST_STEPS:
                self.seen.clear()
            low, high, at, depth = node
            letters, ends = self.letters, self.ends
            own = letter.encode("utf-8", "replace")
            if high - low == 1:  # the one word with this beginning
                start, at = ends[low] + at, at + len(own)
                return (low, high, at, depth + 1) if ends[low] + at <= ends[high] and letters[start : start + len(own)] == own else ()
            for x in own:
                if low < high and ends[low] + at == ends[low + 1]:  # the beginning itself
                    low += 1
                key = lambda i, at=at: letters[ends[i] + at]
                low = bisect_left(range(high), x, low, high, key=key)
                high = bisect_left(range(high), x + 1, low, high, key=key)
                at += 1
            got = self.seen[node, letter] = (low, high, at, depth + 1) if low < high else ()
        return got

    def walk(self, text: str) -> tuple:
        if not text:
            return self.root
        low, high = 0, self.n
        if len(text) > 4:
            span = self.spans.get(text[:4])
            if span is None:
                if len(self.spans) > MOST_STEPS:
                    self.spans.clear()
                span = self.spans[text[:4]] = self.walk(text[:4])
            if not span:
                return ()
            low, high = span[:2]
        own, letters, ends = text.encode("utf-8", "replace"), self.letters, self.ends
        size = len(own)
        key = lambda i: letters[ends[i] : min(ends[i] + size, ends[i + 1])]
        first = last = bisect_left(range(high), own, low, key=key)
        leap = 1
        while last < high and key(last) == own:  # most beginnings have few words
            last, leap = last + leap, 2 * leap
        return (first, bisect_right(range(high), own, max(first, last - leap // 2), min(last, high), key=key), size, len(text)) if last > first else ()

    def count(self, node: tuple) -> int:
        """The count of the word that is the whole beginning, or 0."""
        first, end, at, depth = node
        return self.counts[first] if depth and self.ends[first] + at == self.ends[first + 1] else 0


def trigrams(words, counts) -> dict[str, int]:
    """How often letters stand after two others, in words with two marks before and one after."""
    tri: dict[str, int] = {}
    for w, c in zip(words, counts, strict=True):
        s = "^^" + w + "$"
        for i in range(2, len(s)):
            g = s[i - 2 : i + 1]
            tri[g] = tri.get(g, 0) + c
    return tri


class Channel:
    """Restores tokens under trigram counts and known words."""

    def __init__(self, words: Words | dict[str, int]):
        self.words = words if isinstance(words, Words) else Words.of(words)
        self.total = self.words.total
        self.tri = self.words.tri
        self.bi: dict[str, float] = {}
        self.uni: dict[str, float] = {}
        self.tri2: dict[str, float] = {}
        self.bi1: dict[str, float] = {}
        for g, c in self.tri.items():
            self.bi[g[1:]] = self.bi.get(g[1:], 0) + c
            self.uni[g[2]] = self.uni.get(g[2], 0) + c
            self.tri2[g[:2]] = self.tri2.get(g[:2], 0) + c
        for g, c in self.bi.items():
            self.bi1[g[0]] = self.bi1.get(g[0], 0) + c
        self.chars = sum(self.uni.values()) + 1
        self.steps: dict[str, float] = {}
        self.choices: dict[tuple, list] = {}
        self.tails: dict[tuple, tuple] = {}
        self.tables: dict[str, dict | None] = {}

    def step(self, before: str, c: str) -> float:
        """log probability of c after two letters, interpolated."""
        got = self.steps.get(before + c)
        if got is not None:
            return got
        if len(self.steps) > MOST_WORDS:
            self.steps.clear()
        p = 0.7 * self.tri.get(before + c, 0) / self.tri2.get(before, 1) if before in self.tri2 else 0
        p += 0.2 * self.bi.get(before[1] + c, 0) / self.bi1.get(before[1], 1)
        got = self.steps[before + c] = log(p + 0.09 * self.uni.get(c, 0) / self.chars + 1e-5)
        return got

    def letters(self, text: str) -> float:
        """log probability of letters that begin a word."""
        s = "^^" + text
        return sum(self.step(s[i : i + 2], s[i + 2]) for i in range(len(text)))

    def options(self, c: str, run: int) -> list[tuple[str, float]]:
        """What a character may stand for, with log probabilities; run: how often it has stood in a row."""
        if c.isalpha():
            out = [(c, 0.0)]
        else:
            out = [*((x, -1.0 - 0.3 * len(LEET[c])) for x in LEET.get(c, "")), ("", -1.0 if c in " .-_,'~" else -3.5)]
        if run > 1:
            out.append(("", -0.7 if run == 2 else -0.05))
        return out

    def chosen(self, signs: str) -> list[list]:
        """options() of each of some signs in a row, the likelier way to be none only."""
        out, run = [], 0
        for i, c in enumerate(signs):
            run = run + 1 if i and c == signs[i - 1] else 1
            own = self.options(c, run)
            none = max(cost for x, cost in own if not x)
            out.append([*((x, cost) for x, cost in own if x), ("", none)])
        return out

    def tail(self, two: str, signs: str) -> tuple[float, str]:
        """The likeliest letters of signs after two letters and before a word's end, and their log probability before them."""
        got = self.tails.get((two, signs))
        if got is None:
            states = {two: (0.0, "")}
            for options in self.chosen(signs):
                new: dict[str, tuple] = {}
                for at, (score, path) in states.items():
                    for x, cost in options:
                        s, key = (score + cost + self.step(at, x), at[1] + x) if x else (score + cost, at)
                        old = new.get(key)
                        if old is None or s > old[0]:
                            new[key] = (s, path + x)
                states = new
            got = max(((s + self.step(at, "$"), path) for at, (s, path) in states.items()), key=lambda g: g[0])
            if len(self.tails) > MOST_STEPS:
                self.tails.clear()
            self.tails[two, signs] = got
        return got

    def spellings(self, signs: str) -> dict[bytes, tuple[int, float]] | None:
        """All letters that signs may stand for, numbered, with log probabilities; None if there are too many."""
        if signs not in self.tables:
            table: dict | None = {"": 0.0}
            for options in self.chosen(signs):
                more: dict[str, float] = {}
                for rest, s in table.items():
                    for x, cost in options:
                        if s + cost > more.get(rest + x, NONE):
                            more[rest + x] = s + cost
                table = more
                if len(table) > MOST_SPELLINGS:
                    break
            if len(self.tables) > MOST_SPELLINGS:
                self.tables.clear()
            self.tables[signs] = {x.encode(): (i, s) for i, (x, s) in enumerate(table.items())} if len(table) <= MOST_SPELLINGS else None
        return self.tables[signs]

    def spelled(self, node: tuple, signs: str) -> list[tuple[float, int]]:
        """The known words that a node's letters and signs after them spell: log probability of the signs, place of the word."""
        (low, high, at, _), known = node, self.words
        if high - low <= FEW and (table := self.spellings(signs)) is not None:
            letters, ends = known.letters, known.ends
            met = [(*table[rest], i) for i in range(low, high) if (rest := letters[ends[i] + at : ends[i + 1]]) in table]
            return [(cost, i) for _, cost, i in sorted(met)]
        states = {node: 0.0}
        for options in self.chosen(signs):
            more: dict[tuple, float] = {}
            for node, s in states.items():
                for x, cost in options:
                    to = known.step(node, x) if x else node
                    if to and s + cost > more.get(to, NONE):
                        more[to] = s + cost
            states = more
        return [(cost, to[0]) for to, cost in states.items() if known.count(to)]

    def ended(self, head: str, signs: str) -> str:
        """restore() of letters and the signs (no letters or digits) that follow them; most heads share their last letters."""
        if len(signs) > MOST_LETTERS:
            return self.restore(signs, head)
        score, best = self.tail(("^^" + head)[-2:], signs)
        best, known = head + best, self.words
        if (node := known.walk(head)) and (spelled := self.spelled(node, signs)):
            score += self.letters(head)
            for cost, i in spelled:
                if (own := cost + log(known.counts[i] / self.total)) >= score:
                    score, best = own, known.word(i)
        return best

    def restore(self, token: str, head: str = "") -> str:
        """The likeliest letters of a lower-case token after the letters ``head``; the token itself if it has none."""
        states = {("^^" + head)[-2:]: (self.letters(head), None)}  # by the last two letters: score, letters since the last sure one
        at, known = self.words.walk(head), self.words
        spelled = {at: 0.0} if at else {}  # by node of the trie
        sure, last, run, i = [head], head[-1:], 0, 0
        steps, choices, seen = self.steps, self.choices, known.seen
        if len(choices) > MOST_STEPS:
            choices.clear()
        while i < len(token):
            c = token[i]
            if not spelled and len(states) == 1 and c != last and (m := _PLAIN.match(token, i)) and m.group().isalpha():
                (two, (_, path)), rest = next(iter(states.items())), m.group()  # there is one way to read these, so scores no longer matter
                sure += [_unwound(path), rest]
                states, last, run, i = {rest[-2:]: (0.0, None)}, rest[-1], 1, m.end()
                continue
            run = run + 1 if c == last else 1
            options = choices.get((c, run if run < 3 else 3))
            if options is None:
                options = choices[c, min(run, 3)] = self.options(c, run)
            new: dict[str, tuple] = {}
            for two, (score, path) in states.items():
                for x, cost in options:
                    if x:
                        go = steps.get(two + x)
                        s, key = score + cost + (self.step(two, x) if go is None else go), two[1] + x
                    else:
                        s, key = score + cost, two
                    old = new.get(key)
                    if old is None or s > old[0]:
                        new[key] = (s, (path, x) if x else path)
            states = new
            if len(states) == 1:
                two, (score, path) = next(iter(states.items()))
                sure.append(_unwound(path))
                states = {two: (score, None)}
            if spelled:
                more: dict[tuple, float] = {}
                for node, score in spelled.items():
                    for x, cost in options:
                        to = node
                        if x and (to := seen.get((node, x))) is None:
                            to = known.step(node, x)
                        if to and score + cost > more.get(to, NONE):
                            more[to] = score + cost
                spelled = more
            last = c
            i += 1
        score, best = max((s + self.step(two, "$"), _unwound(path)) for two, (s, path) in states.items())
        best = "".join(sure) + best
        for node, cost in spelled.items():  # a known word's own probability replaces that of its letters, the channel's cost stays
            if (n := known.count(node)) and (own := cost + log(n / self.total)) >= score:
                score, best = own, known.word(node[0])
        return best or token

    def own(self, word: str) -> float:
        """log probability of a word that stands by itself."""
        letters = self.letters(word) + self.step(("^^" + word)[-2:], "$")
        return max(letters, log(n / self.total)) if (n := self.words.get(word)) else letters

    def split(self, run: str) -> list[str]:
        """The likeliest words of lower-case letters and signs without blanks: known words, and restored rests between.

        Every start is met with every known word that its signs can spell; what is outside known words is spelled by
        trigrams. A sign with no letter is noise wherever it stands, so it is left out first; of a character more than three times
        in a row, three are left.
        """
        run = _LONG.sub(r"\1\1\1", "".join(c for c in run if c.isalpha() or c in LEET))
        n, trie = len(run), self.words
        none = (NONE, -1, "")
        known, rest = [none] * (n + 1), [none] * (n + 1)  # best score at a place, the place before, the word between
        known[0] = (0.0, -1, "")
        for i in range(n):
            free = max(known[i][0], rest[i][0])
            go = self.step(("^^" + run[max(0, i - 2) : i])[-2:], run[i]) if run[i].isalpha() else -3.5
            for score, at in ((known[i][0] + APART, i), (rest[i][0], rest[i][1])):
                if score + go > rest[i + 1][0]:
                    rest[i + 1] = (score + go, at, "")
            states = {trie.root: free}
            for j in range(i, n):
                c = run[j]
                options = [(c, 0.0)] if c.isalpha() else [*((x, -1.0 - 0.3 * len(LEET[c])) for x in LEET[c]), ("", -3.5)]
                if j > i and c == run[j - 1]:
                    options.append(("", -0.7))
                new: dict[tuple, float] = {}
                for node, score in states.items():
                    for x, cost in options:
                        to = trie.step(node, x) if x else node
                        s = score + cost
                        if to and to[3] and s > new.get(to, free - 3.5 * (to[3] + 2)):  # at most about as many signs of noise as letters; noise before a word belongs to the rest before it
                            new[to] = s
                if not new:
                    break
                for node, score in new.items():
                    if (count := trie.count(node)) and (s := score + log(count / self.total)) > known[j + 1][0]:
                        known[j + 1] = (s, i, trie.word(node[0]))
                states = new
        out, i = [], n
        while i > 0:
            if known[i][0] >= rest[i][0]:
                out.append(known[i][2])
                i = known[i][1]
            else:  # from the start of a rest, which follows a known word
                a = rest[i][1]
                out.append(self.restore(run[a:i]))
                i = a
                if i > 0:
                    out.append(known[i][2])
                    i = known[i][1]
        return out[::-1]


def _unwound(path) -> str:
    """The letters of a path (path before, letter)."""
    out = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


_BEGINNINGS = [[slice(k) for k in range(5, n + 1)] for n in range(9)]  # by the letters of a word


def spaced(tokens: list[str], sizes: list[int]) -> Iterator[str]:
    """The characters of each run of three or more tokens of one character, as long as runs go; sizes: the tokens' lengths."""
    if sizes.count(1) < 3:
        return
    first = last = -2
    for i in chain((i for i, n in enumerate(sizes) if n == 1), (len(sizes) + 1,)):
        if i != last + 1:
            if last - first >= 2:
                yield "".join(tokens[first : last + 1])
            first = i
        last = i


def features(word: str) -> list[int]:
    """Hashes of a restored word and of its beginnings, which words of one stem share."""
    own = "^" + word
    return [*map(_hash, (word, *[own[k] for k in _BEGINNINGS[len(word)]]))] if len(word) < 9 else [*map(_hash, (word, own[:5], own[:6], own[:7], own[:8], own[:9]))]


class Reader:
    """Whole texts to the restored words they hold; kept: what is to be known of a word, empty for most."""

    def __init__(self, channel: Channel, kept, targets=()):
        self.channel, self.kept = channel, kept
        self.single: dict[str, str] = {}
        for w in sorted(targets):
            self.single.setdefault(_DOUBLE.sub(r"\1", w), w)
        self.targets, self.sorted = frozenset(targets), sorted(targets)
        self.heads = {w[:k] for w in targets for k in range(1, min(len(w), MOST_LETTERS + 1))}
        self.whole = self.heads.union(w for w in targets if len(w) <= MOST_LETTERS)
        self.cache: dict[str, tuple] = {}  # of tokens of which something is to be known
        self.idle: set[str] = set()  # the other tokens

    def word(self, token: str) -> str:
        core = token if token.isalpha() else core_of(token)
        if not core.isalpha():
            if not any(x.isalpha() for x in core):
                return ""
            end = next(i for i, x in enumerate(core) if not x.isalpha())
            if not end or any(x.isalnum() for x in core[end:]) or _THRICE.search(core[:end]):
                return self.channel.restore(core)
            core = self.channel.ended(core[:end], core[end:])  # signs at the end: letters or noise, as the decoder prefers
        elif not _DOUBLE.search(core):
            return core
        elif _THRICE.search(core):
            return self.channel.restore(core)
        plain = _DOUBLE.sub(r"\1", core) if self.single else core
        own = self.single.get(plain) if plain != core else None
        return own if own and core not in self.channel.words else core

    def read(self, text: str | None) -> list[tuple]:
        if not text:
            return []
        tokens = text.lower().split()
        cache, idle = self.cache, self.idle
        if len(cache) > MOST_WORDS:
            cache.clear()
        if len(idle) > MOST_IDLE:
            idle.clear()
        out, met = [], set(tokens) - idle
        for w in met.difference(cache):
            plain = self.word(w)
            got = self.kept(plain) if plain else ()
            if len(w) > MOST_LETTERS:
                if got:
                    out.append(got)
            elif got:
                cache[w] = got
            else:
                idle.add(w)
        out += filter(None, map(cache.get, met))
        sizes = list(map(len, tokens))
        for run in spaced(tokens, sizes):
            if sum(x.isalpha() for x in run) >= 3:
                for a in range(min(2, len(run) - 2)):  # a one-letter word may stand before or after the letters
                    for b in range(len(run), max(a + 2, len(run) - 2), -1):
                        if got := self.kept(self.channel.restore(run[a:b])):
                            out.append(got)
                out += filter(None, map(self.kept, self.channel.split(run)))
        if self.heads:
            out += self.chunks(tokens, sizes)
        return out

    def begins(self, w: str) -> bool:
        """Whether a longer target begins with w."""
        if len(w) <= MOST_LETTERS or w[:MOST_LETTERS] not in self.heads:
            return w in self.heads
        at = bisect_left(self.sorted, w)
        return any(t != w and t.startswith(w) for t in self.sorted[at : at + 2])

    def chunks(self, tokens: list[str], sizes: list[int]) -> list[tuple]:
        """Target words that blanks cut into pieces, where the decoder prefers the word to its pieces."""
        out, own, heads, whole = [], self.channel.own, self.heads, self.whole
        # a target goes on with the letters of the next token, or with its first ones if signs follow them
        starts = [i for i, (w, x) in enumerate(pairwise(tokens)) if w in heads and (w + (x if x.isalpha() else x[0]))[:MOST_LETTERS] in whole]
        if max(sizes, default=0) > MOST_LETTERS:
            starts = sorted({*starts, *(i for i, n in enumerate(sizes) if n > MOST_LETTERS)})
        for i in starts:
            w, j = tokens[i], i + 1
            while j < len(tokens) and self.begins(w):
                w += tokens[j]
                j += 1
                target = trimmed(w)
                if target in self.targets:
                    parts = [x for x in (*tokens[i : j - 1], trimmed(tokens[j - 1])) if x]
                    if own(target) - 3.5 * (j - i - 1) > sum(map(own, parts)) and not any(map(self.kept, parts)):  # a blank in a word costs as noise does
                        out.append(self.kept(target))
        return out


def _signed(batches):
    """Learning texts with their two smallest shingle hashes; of the equal ones that a task meets, one."""
    met: set[tuple] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            keys = [(c, xxhash.xxh3_128_digest(x.as_py() or b"")) for c, x in zip(part.column("class").to_pylist(), part.column("text"), strict=True)]
            take = []
            for k in keys:
                take.append(k not in met)
                met.add(k)
            part = pa.Table.from_batches([part]).filter(pa.array(take))
            lows = np.zeros((part.num_rows, 2), np.int64)
            for row, x in zip(lows, part.column("text"), strict=True):
                least = np.sort(shingle_set(x.as_py(), 4))[:2].view(np.int64)
                row[: len(least)] = least
            for b in pa.table({"class": part.column("class"), "low": lows[:, 0].copy(), "next": lows[:, 1].copy(), "text": part.column("text")}).to_batches():
                yield b


def _unlike(batches):
    """Of the texts that share a class and their two smallest shingle hashes, those not near (0.8) to one taken before."""
    key, last, first, kept = (), None, None, []  # first: a text taken whose set is not yet made
    for batch in batches:
        take = np.zeros(batch.num_rows, bool)
        for i, (*own, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("class", "low", "next")), batch.column("text"), strict=True)):
            text = text.as_py()
            if own != key:
                key, last, first, kept, take[i] = own, text, text, [], True
                continue
            if text == last:
                continue
            last = text
            if not kept:
                kept = [shingle_set(first, 4)]
            s = shingle_set(text, 4)
            if not any(_near(s, k) for k in kept):
                kept.append(s)
                take[i] = True
        found = pa.Table.from_batches([batch]).filter(pa.array(take))
        yield from found.select(["class", "text"]).to_batches()


def _near(s: np.ndarray, k: np.ndarray) -> bool:
    if 5 * min(len(s), len(k)) < 4 * max(len(s), len(k)):
        return False
    both = len(np.intersect1d(s, k, assume_unique=True))
    return 5 * both >= 4 * (len(s) + len(k) - both)


def _decoded(column) -> list[str]:
    return [(x.as_py() or b"").decode("utf-8", "replace") for x in column]


def _words(batches):
    """Plain words and their counts."""
    for batch in batches:
        tokens: Counter = Counter()
        for text in _decoded(batch.column("text")):
            tokens.update(text.lower().split())
        words: dict[str, int] = {}
        for token, n in tokens.items():
            w = trimmed(token)
            if w.isalpha():
                words[w] = words.get(w, 0) + n
        yield pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array(words.values(), pa.int64())})


def _trigrams(batches):
    for batch in batches:
        tri = trigrams(batch.column("word").to_pylist(), batch.column("n").to_pylist())
        yield pa.record_batch({"tri": pa.array(tri, pa.string()), "n": pa.array(tri.values(), pa.int64())})


def _features(words, known):
    """For each feature of a task's texts (of those known, if given), how many texts hold it."""

    def run(batches):
        place = {f: i for i, f in enumerate(known.value.tolist())} if known else None
        kept = (lambda w: tuple(map(place.__getitem__, filter(place.__contains__, features(w))))) if known else lambda w: tuple(features(w))
        reader = Reader(_channel(words), kept)
        for batch in batches:
            found: Counter = Counter()
            for text in _decoded(batch.column("text")):
                found.update(set(chain.from_iterable(reader.read(text))))
            feature = np.fromiter(found, np.int64 if known else np.uint64, len(found))
            yield pa.record_batch({"feature": pa.array((known.value[feature] if known else feature).view(np.int64)), "n": pa.array(found.values(), pa.int64())})

    return run


def _telling(weights):
    """The words that have a weight themselves."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"word": pa.array([w for w in batch.column("word").to_pylist() if xxhash.xxh3_64_intdigest(w) in weights.value], pa.string())})

    return run


def chance(b: int, m: int, p: float) -> float:
    """The chance that b or more of m texts are toxic, where a share p is."""
    term = exp(lgamma(m + 1) - lgamma(b + 1) - lgamma(m - b + 1) + b * log(p) + (m - b) * log1p(-p))
    out = term
    for k in range(b, m):
        term *= (m - k) / (k + 1) * p / (1 - p)
        out += term
        if term < 1e-3 * BEYOND / m or out > 1:
            break
    return out


def fitted_line(t: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic line by Newton's steps with a light ridge on the slope; n: how often t and y are met."""
    slope, bias = 0.5, -2.0
    for _ in range(50):
        p = sigmoid(slope * t + bias)
        w = n * (p * (1 - p) + 1e-6)
        d = n * (p - y)
        g = np.array([(d * t).sum() + 0.01 * slope, d.sum()])
        h = np.array([[(w * t * t).sum() + 0.01, (w * t).sum()], [(w * t).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, bias = slope - float(np.clip(step[0], -1, 1)), bias - float(np.clip(step[1], -2, 2))
    return slope, bias


def _line(totals: DataFrame) -> tuple[float, float]:
    """Slope and bias from (class, total) of the learning texts; the driver gets a row for each distinct pair."""
    got = totals.groupBy("class", "total").count().toArrow()
    y, t, n = (got.column(c).to_numpy().astype(float) for c in ("class", "total", "count"))
    order = np.lexsort((t, y))
    return fitted_line(t[order], y[order], n[order])


def _model(rows: DataFrame, scratch: Scratch, least: int):
    """(learning texts taken, their numbers by class, broadcast words, weights, targets), or None if a class is missing."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    signed = rows.mapInArrow(_signed, "class int, low long, next long, text binary").repartition("class", "low", "next").sortWithinPartitions("class", "low", "next", "text")
    texts = scratch.table(signed.mapInArrow(_unlike, "class int, text binary"), "unlike")
    n = {r["class"]: r["count"] for r in texts.groupBy("class").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not (n0 and n1):
        return None
    known = scratch.table(texts.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    tri = known.mapInArrow(_trigrams, "tri string, n long").groupBy("tri").agg(F.sum("n").alias("n")).toArrow()
    own = known.orderBy("word").toArrow().combine_chunks()
    column = own.column("word").chunk(0) if own.num_rows else pa.array([], pa.string())
    counts = own.column("n").chunk(0) if own.num_rows else pa.array([], pa.int64())
    words = sc.broadcast(Words.sorted(column.cast(pa.string()), counts, dict(sorted(zip(tri.column("tri").to_pylist(), tri.column("n").to_pylist(), strict=True)))))
    del own, column, counts

    def held(c: int, asked=None) -> DataFrame:
        return texts.where(F.col("class") == c).mapInArrow(_features(words, asked), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    toxic = held(1).where(F.col("n") >= least).orderBy("feature").toArrow()
    feature, b = toxic.column("feature").to_numpy(), toxic.column("n").to_numpy()
    asked = sc.broadcast(feature.view(np.uint64))
    clean = held(0, asked).toArrow()
    asked.destroy()
    a = np.zeros(len(b), np.int64)
    a[np.searchsorted(feature, clean.column("feature").to_numpy())] = clean.column("n").to_numpy()
    z = (b / n1 - a / n0) / np.sqrt((a + b) / (n0 + n1) * (1 / n1 + 1 / n0) + 1e-12)
    odds = np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1))
    fit = (z > 4) & (odds > 2)  # z keeps out chance words, by how many texts there are
    p = n1 / (n0 + n1)
    for i in np.flatnonzero(fit):  # and the exact tail does where the classes are unequal and the numbers small
        fit[i] = chance(int(b[i]), int(a[i] + b[i]), p) < BEYOND
    weights = dict(sorted(zip(feature.view(np.uint64)[fit].tolist(), odds[fit].tolist(), strict=True)))
    shared = sc.broadcast(weights)
    targets = sorted(r["word"] for r in known.mapInArrow(_telling(shared), "word string").collect())
    shared.destroy()
    return texts, (n0, n1), words, weights, targets


def learn(rows: DataFrame, scratch: Scratch, *, least: int = 4) -> tuple | None:
    """(known words for the channel, weights of telling features, (slope, bias), the classes of the texts used, a byte each).

    rows: class (0 or 1), text (binary), of any number; all are learned from. Near copies are learned from once: a text
    of a class that shares its two smallest shingle hashes with one taken before, and is near to it (0.8), is left out.
    The channel knows every word that these texts hold twice. A feature tells if ``least`` toxic texts hold it and its
    shares in the classes differ beyond chance (z > 4 and the exact tail beyond it, log odds > 2). Texts are read by the
    executors; the driver gets words, the features that ``least`` toxic texts hold, and distinct totals. None if a class
    is missing.
    """
    got = _model(rows, scratch, least)
    if got is None:
        return None
    texts, (n0, n1), words, weights, targets = got
    model = rows.sparkSession.sparkContext.broadcast((weights, (1.0, 0.0), targets))
    line = _line(texts.mapInArrow(_totals(words, model, ["class"]), "class int, total double, words array<string>"))
    model.destroy()
    return words.value, weights, line, bytes(n0) + b"\x01" * n1


class Scorer:
    """Scores of whole texts under learned words, weights, slope and bias."""

    def __init__(self, words: Channel | Words | dict[str, int], weights: dict[int, float], line: tuple[float, float], targets: list[str] | None = None):
        def kept(w: str) -> tuple:
            own = features(w)
            return () if telling.isdisjoint(own) else (w, max(weights[f] for f in own if f in weights))

        telling = frozenset(weights)

        self.line = line
        self.channel = words if isinstance(words, Channel) else Channel(words)
        self.reader = Reader(self.channel, kept, {w for w in self.channel.words if _hash(w) in weights} if targets is None else targets)

    def total(self, text: str | None) -> tuple[float, list[str]]:
        """The distinct telling words' weights, added up, and those words."""
        found = dict(self.reader.read(text))
        return sum(found[w] for w in sorted(found)), sorted(found)

    def score(self, text: str | None) -> tuple[float, list[str]]:
        total, words = self.total(text)
        return float(sigmoid(np.float64(self.line[0] * total + self.line[1]))), words


_CHANNELS: dict[int, tuple] = {}  # of a worker: the words in use and their channel, which the worker's tasks share
_SCORERS: dict[int, tuple] = {}  # of a worker: the model in use and its scorer, which the worker's tasks share


def _channel(words) -> Channel:
    own = words.value
    if id(own) not in _CHANNELS:
        _CHANNELS.clear()
        _CHANNELS[id(own)] = (own, Channel(own))
    return _CHANNELS[id(own)][1]


def _scorer(words, model) -> Scorer:
    own = model.value
    if id(own) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(own)] = (own, Scorer(_channel(words), *own))
    return _SCORERS[id(own)][1]


def _totals(words, model, columns: list[str]):
    """The columns, and the total and the telling words of each text (binary)."""

    def run(batches):
        scorer = _scorer(words, model)
        for batch in batches:
            got = [scorer.total(t) for t in _decoded(batch.column("text"))]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.string()))], [*columns, "total", "words"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, out_fold: int = 0, cut: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= cut), words (restored, telling).

    Learned from all labelled texts outside the held-out fold. Null and empty texts hold no word and get the least
    score. With labels of one class only, or none, the score is that class, or zero; an empty table gives an empty
    result. Null labels are not used; an id with several labels is learned with each, a text under several ids is one
    learning text (near copies count once). Repeated and null ids keep their rows; other columns, such as one named
    words, are ignored. Each text is scored once, into a scratch table that the line of the scores is fitted on.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).withColumn("held_out", fold("doc_id", folds) == out_fold)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("class")).where("class in (0, 1)").where(fold("doc_id", folds) != out_fold).distinct()
    rows = all_labelled_rows(d.where("not held_out"), marks)
    learned = _model(rows, scratch, 4)
    if learned is None:
        constant = float(rows.agg(F.coalesce(F.avg("class"), F.lit(0.0))).first()[0])
        scratch.close()
        return d.select("doc_id", "held_out", F.lit(constant).alias("score"), F.lit(int(constant >= cut)).alias("predicted"), F.array().cast("array<string>").alias("words"))
    texts, (n0, n1), words, weights, targets = learned
    model = spark.sparkContext.broadcast((weights, (1.0, 0.0), targets))
    kind = d.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "held_out", "h"]
    scored = d.withColumn("h", F.xxhash64("text")).mapInArrow(_totals(words, model, columns), f"doc_id {kind}, held_out boolean, h long, total double, words array<string>")
    scored = scratch.table(scored, "scored")
    model.destroy()
    words.destroy()
    used = texts.select("class", F.xxhash64("text").alias("h"))
    slope, bias = _line(used.join(scored.where("not held_out").select("h", "total").distinct(), "h"))
    bias += prior_shift(marks, bytes(n0) + b"\x01" * n1)
    scratch.drop("unlike", "words")
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("total") + F.lit(bias))))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= cut).cast("int").alias("predicted"), "words")
