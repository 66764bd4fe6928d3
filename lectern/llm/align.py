"""Problem 4: sentence alignment of bilingual texts.

1. Units of both sides are aligned by length (dynamic programming over beads
   1-1, 1-0, 0-1, 2-1 and 1-2); 1-1 beads of plausible length are confident.
2. Word-translation probabilities (IBM model 1, one table per language pair) are
   trained on all confident beads by expectation-maximisation: every task counts
   in arrays and emits sums, the cluster adds them up by key and normalises.
3. Units are realigned by dynamic programming over the same beads, a bead being
   worth what its words explain of each other; units left over on both sides
   are then paired where they explain each other wherever they stand (moved).

Both dynamic programmes look within a band about the diagonal, which is made
wider until the best path stays clear of its edge or nothing is left out.  What
words explain of each other is kept for pairs of units that share any; of a text of
more than ``WHOLE`` pairs for those within the band only.  Its units left over are
compared with all others one unit at a time, so no word is passed over and no text
needs a matrix of all its units.

Words are hashed into 2^14 buckets; a table keeps the translations of at least
``MIN_PROB``.  The tables stay in the shared folder, a part per language pair; rows
are sorted by language pair within their partitions, so a task opens one part after
another, and the driver none.  Scripts without blanks count pairs of adjacent signs
as words; figures stand for themselves.

Defined results: a NULL or empty side gives no pairs; notes in brackets render
nothing; equal units pair as such; a segment given twice counts once.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrowio import loaded, map_texts, stored, str_col
from lectern.llm.langid import LANGS
from lectern.llm.pairs import filler
from lectern.llm.units import units_of

BITS = 14
MIN_PROB = 0.01
ROUNDS = 3
#: What a word must be explained to on average for its units to be paired, and
#: what their lengths weigh beside that; the same for tables of any size.
NEED, LENGTH = 0.5, 0.1
#: What a word explains that is the same on both sides.
SAME = 0.9
#: Of two units that together are one: least explanation of each one's words,
#: and least addition to what the other explains.
PART, ADDS = 0.45, 0.12

_TOKEN = re.compile(r"\d+(?:[.,\u00a0\u202f]\d+|\u0020\d{3}(?!\d))*|[\u3040-\u30ff\u3400-\u9fff\u3005]+|[^\W\d_]+")
_SEPARATORS = re.compile(r"[.,\u0020\u00a0\u202f]")
_NOTE = re.compile(r"[\[（(【]|.*[\]）)】]\Z", re.S)
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")


@lru_cache(maxsize=1 << 17)
def word_id(word: str) -> int:
    return 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % ((1 << BITS) - 1)


def tokens(text: str) -> tuple[list[int], list[int]]:
    """(words, marks): ids of words, and of figures or whole odd units, which
    must be the same on both sides."""
    words: set[int] = set()
    marks: set[int] = set()
    if filler(text):
        return [], [zlib.crc32("".join(c for c in text.casefold() if c.isalnum()).encode("utf-8", "surrogatepass"))]
    for m in _TOKEN.finditer(text):
        w = m[0]
        if w[0].isdigit():
            marks.add(zlib.crc32(_SEPARATORS.sub("", w).encode()))
        elif _CJK.match(w):
            for k in range(len(w) - 1):
                words.add(word_id(w[k : k + 2]))
            if len(w) == 1:
                words.add(word_id(w))
        else:
            words.add(word_id(w.lower()))
    if not words and not marks:
        marks.add(zlib.crc32(text.strip().encode("utf-8", "surrogatepass")))
    return sorted(words), sorted(marks)


#: Half the width of the bands that are tried first.
LENGTH_BAND, BAND = 8, 12


def _widening(n: int, m: int, band: int, path: Callable[[int], list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The best path, in a band that is made wider until the path stays clear of
    its edge or the band holds everything."""
    band += abs(n - m)
    while True:
        got = path(band)
        if band >= max(n, m) or all(abs(j - i * m // max(n, 1)) < band - 1 for i, j in got):
            return got
        band *= 4


def by_length(a: list[int], b: list[int], band: int = LENGTH_BAND) -> list[tuple[int, int, float]]:
    """1-1 beads (i, j, cost) of the best alignment by length alone."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    ratio = max(sum(b), 1) / max(sum(a), 1)
    x = [v * ratio for v in a]

    def cost(u: float, v: float) -> float:
        return (u - v) ** 2 / (1.4 * (u + v) + 1)

    if n == m:
        ones = [(i, i, cost(x[i], b[i])) for i in range(n)]
        if sum(c for *_, c in ones) <= 6.0:  # any other way has a 2-1 and a 1-2 bead at least
            return ones
    best: dict[tuple[int, int], tuple[float, int, int]] = {}

    def path(band: int) -> list[tuple[int, int]]:
        best.clear()
        best[0, 0] = (0.0, 0, 0)
        for i in range(n + 1):
            mid = i * m // n
            for j in range(max(0, mid - band), min(m, mid + band) + 1):
                step(i, j)
        out, i, j = [], n, m
        while i or j:
            out.append((i, j))
            _, di, dj = best[i, j]
            i, j = i - di, j - dj
        return out

    def step(i: int, j: int) -> None:
        top = None if i or j else (0.0, 0, 0)
        if i and j and (g := best.get((i - 1, j - 1))):
            top = (g[0] + cost(x[i - 1], b[j - 1]), 1, 1)
        if i and (g := best.get((i - 1, j))) and (top is None or g[0] + 8.0 < top[0]):
            top = (g[0] + 8.0, 1, 0)
        if j and (g := best.get((i, j - 1))) and (top is None or g[0] + 8.0 < top[0]):
            top = (g[0] + 8.0, 0, 1)
        if i > 1 and j and (g := best.get((i - 2, j - 1))) and (top is None or g[0] + 3.0 < top[0]):
            c = g[0] + 3.0 + cost(x[i - 2] + x[i - 1], b[j - 1])
            top = (c, 2, 1) if top is None or c < top[0] else top
        if i and j > 1 and (g := best.get((i - 1, j - 2))) and (top is None or g[0] + 3.0 < top[0]):
            c = g[0] + 3.0 + cost(x[i - 1], b[j - 2] + b[j - 1])
            top = (c, 1, 2) if top is None or c < top[0] else top
        if top is not None:
            best[i, j] = top
    out = []
    for i, j in _widening(n, m, band, path):
        c, di, dj = best[i, j]
        if di == dj == 1:
            out.append((i - 1, j - 1, c - best[i - 1, j - 1][0]))
    return out[::-1]


_COLUMNS = (
    "s_start array<int>, t_start array<int>, s_len array<int>, t_len array<int>, s_word array<int>, s_off array<int>, "
    "t_word array<int>, t_off array<int>, s_mark array<bigint>, s_moff array<int>, t_mark array<bigint>, t_moff array<int>, bead_s array<int>, bead_t array<int>"
)
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _side(text: str, units: list[tuple[int, int]]) -> tuple[list, list, list, list, list, list]:
    start, length, word, off, mark, moff = [], [], [], [0], [], [0]
    for a, b in units:
        piece = text[a:b]
        w, k = ([], []) if _NOTE.match(piece) else tokens(piece)
        word += w
        mark += k
        start.append(a)
        length.append(b - a)
        off.append(len(word))
        moff.append(len(mark))
    return start, length, word, off, mark, moff


def prepared(source: str, result: str, su: list[tuple[int, int]], tu: list[tuple[int, int]]) -> dict[str, list | None]:
    """Units and words of both sides and their confident beads; NULLs where a side
    has none."""
    if not su or not tu:
        return dict.fromkeys(_NAMES)
    s, t = _side(source, su), _side(result, tu)
    good = [(x, y) for x, y, c in by_length(s[1], t[1]) if c < 3.0 and s[3][x + 1] > s[3][x] and t[3][y + 1] > t[3][y]]
    values = (s[0], t[0], s[1], t[1], s[2], s[3], t[2], t[3], s[4], s[5], t[4], t[5], [x for x, _ in good], [y for _, y in good])
    return dict(zip(_NAMES, values))


class Lexicon:
    """p(target word | source word) of one language pair, by sorted keys."""

    def __init__(self, key: np.ndarray, prob: np.ndarray) -> None:
        order = np.argsort(key)
        self.key, self.prob = key[order], prob[order].astype(np.float32)
        self.words: dict[int, list[tuple[int, float]]] = {}

    def of(self, key: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), otherwise, dtype=np.float32)
        i = np.searchsorted(self.key, key)
        i[i == len(self.key)] = 0
        return np.where(self.key[i] == key, self.prob[i], np.float32(otherwise))

    def translations(self, word: int) -> list[tuple[int, float]]:
        """(target word, how far it is explained) of a source word."""
        got = self.words.get(word)
        if got is None:
            lo, hi = np.searchsorted(self.key, (word << BITS, (word + 1) << BITS))
            weight = np.minimum(1.0, self.prob[lo:hi] / 0.15)
            got = self.words[word] = list(zip((self.key[lo:hi] & ((1 << BITS) - 1)).tolist(), weight.tolist()))
        return got


NO_WORDS = Lexicon(np.zeros(0, np.int64), np.zeros(0))


@lru_cache(maxsize=1)
def _part(path: str, pair: int) -> Lexicon:
    """The table of one language pair; rows come sorted by it."""
    t = loaded(f"{path}/pair={pair}", ["key", "prob"])
    return Lexicon(t.column("key").to_numpy().astype(np.int64), t.column("prob").to_numpy().astype(np.float64))


def _counts(rows: list[tuple], lex: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of (source word, target word) of rows of one language pair:
    (s_word, s_off, t_word, t_off, bead_s, bead_t)."""
    s_tok, t_tok, ns, nt = [], [], [], []
    for sw, so, tw, to, bs, bt in rows:
        for i, j in zip(bs, bt):
            x, y = sw[so[i] : so[i + 1]], tw[to[j] : to[j + 1]]
            s_tok += x
            s_tok.append(0)  # the empty word
            t_tok += y
            ns.append(len(x) + 1)
            nt.append(len(y))
    if not ns:
        return np.zeros(0, np.int64), np.zeros(0)
    s, t = np.asarray(s_tok, dtype=np.int64), np.asarray(t_tok, dtype=np.int64)
    n_s, n_t = np.asarray(ns), np.asarray(nt)
    bead_of_s = np.repeat(np.arange(len(n_s)), n_s)
    t_first = np.cumsum(n_t) - n_t
    rep = n_t[bead_of_s]
    at = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(t_first[bead_of_s], rep)
    key = np.repeat(s << BITS, rep) | t[at]
    if lex is None:
        w = np.repeat(1.0 / n_s[bead_of_s], rep)
    else:
        w = lex.of(key, 1e-6).astype(np.float64)
        w /= np.bincount(at, weights=w, minlength=len(t))[at]
    return _summed(key, w)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


#: Beads counted at a time, and entries held before they are added up.
_ROWS, _HELD = 400, 4_000_000
#: A task keeps to itself the counts below this part of their source word's: they
#: can't reach MIN_PROB, and what is lost of a probability is no more than this.
LEAST = MIN_PROB / 20


def _sums(path: str | None):  # noqa: ANN202
    """Counts (pair, key, n) and totals (key: the source word's, prob 1) of a task."""

    def batch(pair: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        word = key >> BITS
        first = np.flatnonzero(np.diff(word, prepend=-1))
        total = np.add.reduceat(n, first)
        keep = n >= LEAST * np.repeat(total, np.diff(np.append(first, len(word))))
        key, n = np.concatenate((key[keep], -1 - word[first])), np.concatenate((n[keep], total))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), pair, dtype=np.int32)), pa.array(key), pa.array(n)], names=["pair", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        waiting: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def count() -> None:
            nonlocal size, held
            if waiting:
                held.append(_counts(waiting, _part(path, at) if path else None))
                size += len(held[-1][0])
                waiting.clear()
            if size > _HELD:
                held = [_summed(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))]
                size = len(held[0][0])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size
            count()
            if size:
                yield batch(at, *_summed(*(np.concatenate([h[k] for h in held]) for k in (0, 1))))
            held.clear()
            size = 0

        for b in batches:
            for pair, *row in zip(*(str_col(b, c) for c in ("pair", "s_word", "s_off", "t_word", "t_off", "bead_s", "bead_t"))):
                if pair != at:
                    yield from close()
                    at = pair
                waiting.append(tuple(row))
                if len(waiting) >= _ROWS:
                    count()
        yield from close()

    return run


def train(rows: DataFrame, rounds: int = ROUNDS) -> str | None:
    """Path of the tables of word translations, a part per language pair.  ``rows``:
    prepared rows sorted by pair within their partitions."""
    path: str | None = None
    need = rows.select("pair", "s_word", "s_off", "t_word", "t_off", "bead_s", "bead_t").where("size(bead_s) > 0")
    for _ in range(rounds):
        word = F.when(F.col("key") < 0, -1 - F.col("key")).otherwise(F.shiftright("key", BITS))
        sums = need.mapInArrow(_sums(path), "pair int, key bigint, n double").withColumn("word", word)
        # Dealt by source word once: the sums and each word's total need no more.
        sums = sums.repartition("pair", "word").groupBy("pair", "word", "key").agg(F.sum("n").alias("n"))
        total = F.max(F.when(F.col("key") < 0, F.col("n"))).over(Window.partitionBy("pair", "word"))
        table = sums.withColumn("total", total).where((F.col("key") >= 0) & (F.col("n") >= MIN_PROB * F.col("total")))
        path = stored(table.select("pair", "key", (F.col("n") / F.col("total")).cast("float").alias("prob")).repartition("pair"), "pair")
    return path


#: Up to so many pairs of units, all are held at once; of longer texts those about the
#: diagonal are, and the others are worked out by unit where they are asked for.
WHOLE = 1 << 14
#: Counterparts of a moved unit listed at a time, and candidates for parts of units held.
_LISTED, _PARTS = 64, 4_000_000


class _Shared:
    """What the words of two texts explain of each other, by unit and word."""

    def __init__(self, lex: Lexicon, row: dict) -> None:
        n, m = len(row["s_start"]), len(row["t_start"])
        # Marks are words that must be the same on both sides: negative numbers.
        side = lambda w, off, mark, moff, k: [[*w[off[i] : off[i + 1]], *(-1 - x for x in mark[moff[i] : moff[i + 1]])] for i in range(k)]
        self.s, self.t = side(row["s_word"], row["s_off"], row["s_mark"], row["s_moff"], n), side(row["t_word"], row["t_off"], row["t_mark"], row["t_moff"], m)
        s_in: dict[int, list[int]] = {}
        t_in: dict[int, list[int]] = {}
        for units, own in ((self.s, s_in), (self.t, t_in)):
            for k, words in enumerate(units):
                for w in words:
                    own.setdefault(w, []).append(k)
        self.by_s: list[dict[int, float]] = [{} for _ in range(n)]  # target words
        self.by_t: list[dict[int, float]] = [{} for _ in range(m)]  # source words
        for word, units in s_in.items():
            hits = [(t, w) for t, w in lex.translations(word) if t in t_in] if word >= 0 else []
            if word in t_in:  # names, loans, figures
                hits.append((word, SAME if word >= 0 else 1.0))
            for t, w in hits:
                for i in units:
                    d = self.by_s[i]
                    if w > d.get(t, 0.0):
                        d[t] = w
                for j in t_in[t]:
                    d = self.by_t[j]
                    if w > d.get(word, 0.0):
                        d[word] = w
        self.s_in, self.t_in, self.n, self.m = s_in, t_in, n, m
        # Mean explanation of a unit's words by a unit of the other side.
        self.t_mean: dict[tuple[int, int], float] = {}  # words of j explained by i
        self.s_mean: dict[tuple[int, int], float] = {}  # words of i explained by j
        self.width = -1
        self.whole = n * m <= WHOLE
        if self.whole:
            self.fill(n + m)

    def fill(self, width: int) -> bool:
        """The means of all pairs no further than ``width`` from the diagonal; whether any
        were wanting."""
        if width <= self.width:
            return False
        n, m, all_of = self.n, self.m, width >= max(self.n, self.m)
        self.width = width
        self.t_mean.clear()
        self.s_mean.clear()
        for i, d in enumerate(self.by_s):
            sums: dict[int, float] = {}
            lo, hi = i * m // n - width, i * m // n + width
            for t, w in d.items():
                units = self.t_in[t]
                for j in units if all_of else units[bisect_left(units, lo) : bisect_right(units, hi)]:
                    sums[j] = sums.get(j, 0.0) + w
            for j, w in sums.items():
                self.t_mean[i, j] = w / len(self.t[j])
        for j, d in enumerate(self.by_t):
            sums = {}
            lo, hi = -((width - j) * n // m), -(-(j + width + 1) * n // m)  # first one, first beyond
            for word, w in d.items():
                units = self.s_in[word]
                for i in units if all_of else units[bisect_left(units, lo) : bisect_left(units, hi)]:
                    sums[i] = sums.get(i, 0.0) + w
            for i, w in sums.items():
                self.s_mean[i, j] = w / len(self.s[i])
        return True


class _Rows:
    """The means of one source unit and all of some target units (``places``), added up
    in the order of ``_Shared.fill``."""

    def __init__(self, shared: _Shared, places: list[int]) -> None:
        self.shared = shared
        at: dict[int, list[int]] = {}
        explained: dict[int, tuple[list[int], list[float]]] = {}
        for k, j in enumerate(places):
            for t in shared.t[j]:
                at.setdefault(t, []).append(k)
            for word, w in shared.by_t[j].items():
                own = explained.setdefault(word, ([], []))
                own[0].append(k)
                own[1].append(w)
        self.at = {t: np.asarray(x) for t, x in at.items()}
        self.explained = {word: (np.asarray(x), np.asarray(w)) for word, (x, w) in explained.items()}
        self.rank = {word: k for k, word in enumerate(shared.s_in)}
        self.length = np.maximum([len(shared.t[j]) for j in places], 1)

    def t(self, i: int) -> np.ndarray:
        """``t_mean`` of source unit i."""
        got = np.zeros(len(self.length))
        for t, w in self.shared.by_s[i].items():
            if (k := self.at.get(t)) is not None:
                got[k] += w
        return got / self.length

    def s(self, i: int) -> np.ndarray:
        """``s_mean`` of source unit i."""
        got = np.zeros(len(self.length))
        for word in sorted((w for w in self.shared.s[i] if w in self.explained), key=self.rank.__getitem__):
            k, w = self.explained[word]
            got[k] += w
        return got / max(len(self.shared.s[i]), 1)


def _moved(free_s: list[int], free_t: list[int], gains: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Free units paired by gain (of a source unit and all of ``free_t``), best first, then
    by place: what sorting all pairs of a gain above 0 gives, with no more than the next
    few of each unit held."""
    is_free = np.ones(len(free_t), dtype=bool)
    listed: dict[int, tuple[np.ndarray, np.ndarray, bool]] = {}
    queue: list[tuple[float, int, int]] = []

    def listing(x: int) -> None:
        g = gains(x)
        at = np.flatnonzero(is_free & (g > 0))
        if len(at):
            order = at[np.argsort(-g[at], kind="stable")]
            listed[x] = order[:_LISTED], g[order[:_LISTED]], len(order) > _LISTED
            heappush(queue, (-float(listed[x][1][0]), x, 0))

    for x in free_s:
        listing(x)
    pairs = []
    while queue:
        _, x, k = heappop(queue)
        places, g, more = listed[x]
        if is_free[places[k]]:
            pairs.append((x, free_t[places[k]]))
            is_free[places[k]] = False
            continue
        left = np.flatnonzero(is_free[places[k:]])
        if len(left):
            heappush(queue, (-float(g[k + left[0]]), x, k + int(left[0])))
        elif more:
            listing(x)
    return pairs


def realign(lex: Lexicon, row: dict, band: int = BAND) -> list[tuple[int, int]]:
    """Pairs (i, j) of source and target units."""
    shared = _Shared(lex, row)
    by_s, by_t, s_of, t_of, t_mean, s_mean = shared.by_s, shared.by_t, shared.s, shared.t, shared.t_mean, shared.s_mean
    n, m = len(s_of), len(t_of)
    a, b = row["s_len"], row["t_len"]
    ratio = max(sum(b), 1) / max(sum(a), 1)
    s_n, t_n = [len(x) for x in s_of], [len(x) for x in t_of]
    logs = [math.log(max(x * ratio, 1.0)) for x in a], [math.log(max(y, 1)) for y in b]
    known: dict[tuple[int, int], float] = {}

    def one(i: int, j: int) -> float:
        """Gain of units i and j being each other's counterparts."""
        got = known.get((i, j))
        if got is None:
            k = i, j
            got = -1.0
            if s_n[i] and t_n[j]:
                length = LENGTH * (0.3 - abs(logs[1][j] - logs[0][i]))
                got = ((t_mean.get(k, 0.0) + s_mean.get(k, 0.0)) / 2 - NEED + length) * (s_n[i] + t_n[j])
            if shared.whole:  # a long text's pairs are asked for about once
                known[k] = got
        return got

    if n == m and shared.whole:
        # Each unit is best explained by its counterpart and no other one could
        # be a part of it: nothing but the diagonal can be the best alignment.
        own = [one(k, k) for k in range(n)]
        if min(own) > 0 and all(i == j or max(t_mean.get((i, j), 0.0), s_mean.get((i, j), 0.0)) < PART and one(i, j) <= min(own[i], own[j]) for i, j in {*t_mean, *s_mean}):
            return [(k, k) for k in range(n)]

    def joint(x: dict[int, float], y: dict[int, float], places: list[int]) -> float:
        """Mean explanation of words by two units together."""
        return sum(max(x.get(q, 0.0), y.get(q, 0.0)) for q in places) / len(places) if places else 0.0

    def two_one(i: int, k: int, j: int) -> float:
        """Gain of source units i and k being one target unit j; each must be
        explained itself and add to what is explained of j."""
        u, v = s_mean.get((i, j), 0.0), s_mean.get((k, j), 0.0)
        if u < PART or v < PART or not t_n[j]:
            return -1.0
        both = joint(by_s[i], by_s[k], t_of[j])
        if both - max(t_mean.get((i, j), 0.0), t_mean.get((k, j), 0.0)) < ADDS:
            return -1.0
        return (both - NEED) * t_n[j] + (u - NEED) * s_n[i] + (v - NEED) * s_n[k]

    def one_two(i: int, j: int, k: int) -> float:
        u, v = t_mean.get((i, j), 0.0), t_mean.get((i, k), 0.0)
        if u < PART or v < PART or not s_n[i]:
            return -1.0
        both = joint(by_t[j], by_t[k], s_of[i])
        if both - max(s_mean.get((i, j), 0.0), s_mean.get((i, k), 0.0)) < ADDS:
            return -1.0
        return (both - NEED) * s_n[i] + (u - NEED) * t_n[j] + (v - NEED) * t_n[k]

    def gain(i: int, j: int, di: int, dj: int) -> float:
        return one(i, j) if di == dj == 1 else two_one(i, i + 1, j) if di == 2 else one_two(i, j, j + 1)

    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    strong_s: set[tuple[int, int]] = set()
    strong_t: set[tuple[int, int]] = set()
    never = (-1e18, 0, 0)

    def path(band: int) -> list[tuple[int, int]]:
        if shared.fill(band + 2 * (m // n + 1) + 3) or not best:  # units of beads that reach in from outside, too
            strong_s.update(k for k, w in s_mean.items() if w >= PART)
            strong_t.update(k for k, w in t_mean.items() if w >= PART)
        best.clear()
        best[0, 0] = (0.0, 0, 0)
        get = best.get
        for i in range(n + 1):
            mid = i * m // n
            for j in range(max(0, mid - band), min(m, mid + band) + 1):
                if i == j == 0:
                    continue
                x, y = i - 1, j - 1
                g, di, dj = -1e18, 0, 0
                if x >= 0 and y >= 0 and (x, y) in best:
                    g, di, dj = best[x, y][0] + one(x, y), 1, 1
                if x >= 0 and (v := get((x, j), never)[0]) > g:
                    g, di, dj = v, 1, 0
                if y >= 0 and (v := get((i, y), never)[0]) > g:
                    g, di, dj = v, 0, 1
                if x > 0 and y >= 0 and (x, y) in strong_s and (x - 1, y) in strong_s and (x - 1, y) in best and (v := best[x - 1, y][0] + two_one(x - 1, x, y)) > g:
                    g, di, dj = v, 2, 1
                if y > 0 and x >= 0 and (x, y) in strong_t and (x, y - 1) in strong_t and (x, y - 1) in best and (v := best[x, y - 1][0] + one_two(x, y - 1, y)) > g:
                    g, di, dj = v, 1, 2
                best[i, j] = g, di, dj
        out, i, j = [], n, m
        while i or j:
            out.append((i, j))
            _, di, dj = best[i, j]
            i, j = i - di, j - dj
        return out

    pairs: list[tuple[int, int]] = []
    for i, j in _widening(n, m, band, path):
        _, di, dj = best[i, j]
        if di and dj and gain(i - di, j - dj, di, dj) > 0:
            pairs += [(x, y) for x in range(i - di, i) for y in range(j - dj, j)]
    # Units moved elsewhere: only those that share words can be counterparts.
    free_s, free_t = set(range(n)) - {x for x, _ in pairs}, set(range(m)) - {y for _, y in pairs}
    if free_s and free_t:
        if shared.whole:
            left = sorted((-one(x, y), x, y) for x, y in {*t_mean, *s_mean} if x in free_s and y in free_t)
            moved = []
            for g, x, y in left:
                if g < 0 and x in free_s and y in free_t:
                    moved.append((x, y))
                    free_s.remove(x)
                    free_t.remove(y)
        else:
            places = sorted(free_t)
            rows, log_t, n_t = _Rows(shared, places), np.asarray([logs[1][y] for y in places]), np.asarray([t_n[y] for y in places])

            def gains(x: int) -> np.ndarray:
                """``one`` of a source unit and the free target units."""
                length = LENGTH * (0.3 - np.abs(log_t - logs[0][x]))
                got = ((rows.t(x) + rows.s(x)) / 2 - NEED + length) * (s_n[x] + n_t)
                return np.where((n_t > 0) & (s_n[x] > 0), got, -1.0)

            moved = _moved(sorted(free_s), places, gains)
            free_s -= {x for x, _ in moved}
            free_t -= {y for _, y in moved}
        pairs += moved
    # Parts of a unit that already has its counterpart, best first.  A target
    # unit nearly always renders something; a source unit may be left out.
    of_s: dict[int, list[int]] = {}
    of_t: dict[int, list[int]] = {}
    for x, y in pairs:
        of_s.setdefault(x, []).append(y)
        of_t.setdefault(y, []).append(x)
    for y, near in _candidates(shared, free_t, 1, PART - 0.1):
        x = _whole(near, of_s, by_t, y, s_of, PART - 0.1, ADDS / 2)
        if x is not None:
            pairs.append((x, y))
            of_s.setdefault(x, []).append(y)
            of_t.setdefault(y, []).append(x)
    for x, near in _candidates(shared, free_s, 0, PART + 0.05):
        y = _whole(near, of_t, by_s, x, t_of, PART + 0.05, ADDS)
        if y is not None:
            pairs.append((x, y))
            of_t.setdefault(y, []).append(x)
    return sorted(pairs)


def _candidates(shared: _Shared, free: set[int], side: int, part: float) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """The free source (``side`` 0) or target units (1), the best explained first, each
    with the units of the other side that explain it by ``part`` at least: how far, which."""
    if not free:
        return
    near: dict[int, list[tuple[float, int]]] = {}
    if shared.whole:
        for k, w in (shared.t_mean if side else shared.s_mean).items():
            if k[side] in free:
                near.setdefault(k[side], []).append((w, k[1 - side]))
        for k in sorted(free, key=lambda k: (-max((w for w, _ in near.get(k, ())), default=0.0), k)):
            yield k, near.get(k, [])
        return
    places = np.asarray(sorted(free))
    if not side:
        rows = _Rows(shared, list(range(shared.m)))
        for x in places[np.argsort([-rows.s(x).max() for x in places], kind="stable")].tolist():
            row = rows.s(x)
            at = np.flatnonzero(row >= part)
            yield x, list(zip(row[at].tolist(), at.tolist()))
        return
    rows = _Rows(shared, places.tolist())
    top, many = np.zeros(len(places)), np.zeros(len(places), dtype=np.int64)
    for x in range(shared.n):
        row = rows.t(x)
        np.maximum(top, row, out=top)
        many += row >= part
    order = np.argsort(-top, kind="stable")
    group = np.cumsum(many[order]) // _PARTS
    for g in np.unique(group):  # as many units at a time as there is room for
        own = places[order[group == g]].tolist()
        rows, near = _Rows(shared, own), {y: [] for y in own}
        for x in range(shared.n):
            row = rows.t(x)
            for k in np.flatnonzero(row >= part).tolist():
                near[own[k]].append((float(row[k]), x))
        yield from near.items()


def _whole(near: list[tuple[float, int]], others: dict[int, list[int]], explains: list[dict[int, float]], own: int, places: list[list[int]], part: float, adds: float) -> int | None:
    """The unit of which ``own``, left over, is a part: the one it is most explained by
    (``near``: how far, which) and adds to what that unit's counterparts (``others``)
    explain of its words."""
    for mean, whole in sorted(near, key=lambda z: (-z[0], z[1])):
        if mean < part:
            break
        words, by = places[whole], others.get(whole)
        if not by or not words:
            continue
        now = [max(explains[k].get(q, 0.0) for k in by) for q in words]
        more = sum(max(0.0, explains[own].get(q, 0.0) - w) for q, w in zip(words, now))
        if more / len(words) >= adds:
            return whole
    return None


def dealt(rows: DataFrame, sound: DataFrame) -> DataFrame:
    """Prepared rows (id and the columns of ``prepared``) of the sound segments (id, sl,
    target_lang), sorted by language pair within their partitions, as a stored table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in LANGS)), F.col(c)), F.lit(0)), F.lit(10)).cast("int") - 1
    own = sound.select("id", (index("sl") * 10 + index("target_lang")).alias("pair"))
    joined = rows.where("s_start is not null and id is not null").repartition(n, "id").join(own.repartition(n, "id"), "id").dropDuplicates(["id"])
    path = stored(joined.select("id", "pair", *_NAMES).sortWithinPartitions("pair"))
    return rows.sparkSession.read.schema(f"id bigint, pair int, {_COLUMNS}").parquet(path)


def aligned(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(segment_id, src_start, tgt_start) of units that render each other."""
    path = train(rows, rounds)

    def fn(b: pa.RecordBatch) -> dict[str, list]:
        names = b.schema.names
        out: dict[str, list] = {"segment_id": [], "src_start": [], "tgt_start": []}
        for values in zip(*(str_col(b, c) for c in names)):
            row = dict(zip(names, values))
            for i, j in realign(_part(path, row["pair"]) if path else NO_WORDS, row):
                out["segment_id"].append(row["id"])
                out["src_start"].append(row["s_start"][i])
                out["tgt_start"].append(row["t_start"][j])
        return out

    return map_texts(rows.drop("bead_s", "bead_t"), fn, "segment_id bigint, src_start int, tgt_start int", ["s_word", "t_word"])


def aligned_units(segments: DataFrame, sound: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The like of texts: ``segments``: id, source_text, result_text; ``sound``: id, sl,
    target_lang."""

    def fn(b: pa.RecordBatch) -> dict[str, list]:
        src, res = ([t or "" for t in str_col(b, c)] for c in ("source_text", "result_text"))
        rows = [prepared(*x) for x in zip(src, res, units_of(src), units_of(res))]
        return {"id": str_col(b, "id")} | {k: [r[k] for r in rows] for k in _NAMES}

    read = map_texts(segments.select("id", "source_text", "result_text"), fn, f"id bigint, {_COLUMNS}", ["source_text", "result_text"])
    return aligned(dealt(read, sound), rounds)
