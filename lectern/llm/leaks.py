"""Problem 8: held-out passages inside the corpus, by the q-gram lemma.

A sentence of an item is held by a document if its words stand there in order
with at most one word put in or changed.  Texts are folded to letters and
figures; word starts are kept beside them.

The lemma, for an edit budget of one word and q-grams taken at every q/2-th place
of a sentence: an edit of a word of at most L characters destroys at most
ceil((L + q - 1) / (q / 2)) of its m samples, so a document that holds the sentence
shares the others, on diagonals no further apart than the longest word.  q is the
largest that leaves a bound of two samples or more.  Every q-gram of every document
is looked up; shared samples are counted by document, sentence and band of
diagonals (bands twice as wide as the longest word, overlapping by half), and bands
below the bound are dropped.  A document stays a candidate for an item if enough
of the item's sentences have a band left.  Those bands are verified by a banded
alignment that moves between two diagonals at most once, at a word.

A sentence too short for any bound (a few letters) isn't filtered: it is looked
for only in documents that are candidates by the item's others, or everywhere
if the item has hardly any others.

The items are the stated query set: tasks cut them into sentences and write them
to the shared folder in blocks of a bounded number of characters.  The corpus is
read and folded once; each task opens one block after another.  Defined results:
NULL or empty texts hold nothing; an item without sentences leaks nowhere; items or
documents given twice count once; a sentence of one word must be there unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrowio import loaded, map_texts, sliced, stored, str_col
from lectern.llm.look import INVISIBLE
from lectern.llm.units import units_of

QS = (16, 8, 4, 2)
#: Characters of items of one block, which is what a task holds of them at a time.
BLOCK_CHARS = 4_000_000
#: Bytes of documents that are folded together before the blocks are opened.
ROUND_BYTES = 24_000_000
#: Least width of half a band of diagonals.
BAND = 32
_BASE = 0x9E3779B97F4A7C15
_BITS = 22


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower) by code: kind 1 letter or figure, 2 such a character that
    is a word by itself, 3 blank, 4 mark that parts words, 0 other."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in (*range(0xD800), *range(0xE000, 0x20000)):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] in "LNM":
            kind[c] = 1
            low = ch.casefold()
            if len(low) == 1:
                lower[c] = ord(low)
        elif ch.isspace():
            kind[c] = 3
        elif ch not in "'’.,_-‐‑·@/":
            kind[c] = 4
    for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        kind[a:b] = np.where(kind[a:b] == 1, 2, kind[a:b]) if a < 0x20000 else 2
    kind[0] = 5  # between texts
    return kind, lower


#: Characters folded, and codes looked up, at a time.
_STEP = 1 << 21
_BLANK = re.compile(r"\s")


def _runs(texts: list[str | None]) -> Iterator[str]:
    """Texts, a 0 behind each, in runs of about ``_STEP`` characters; a longer
    text is cut before a blank."""
    held: list[str] = []
    size = 0
    for t in texts:
        t = (t or "").replace("\0", " ")
        at = 0
        while len(t) - at > _STEP:
            m = _BLANK.search(t, at + _STEP)
            end = m.start() if m else len(t)
            yield "".join(held) + t[at:end]
            held, size, at = [], 0, end
        held.append(t[at:] + "\0")
        size += len(held[-1])
        if size > _STEP:
            yield "".join(held)
            held, size = [], 0
    if held:
        yield "".join(held)


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, word starts, offsets): all texts in one array, a 0 between them."""
    kinds, lower = _tables()
    lows, firsts, ends, base = [], [], [], 0
    for run in _runs(texts):
        if not run.isascii():
            run = INVISIBLE.sub("", run)
            if not unicodedata.is_normalized("NFKC", run):
                run = unicodedata.normalize("NFKC", run)
        codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = kinds[codes]
        at = np.flatnonzero((kind == 1) | (kind == 2) | (kind == 5))
        if not len(at):
            continue
        k = kind[at]
        # Any blank or parting mark since the character kept before.
        g = np.cumsum((kind == 3) | (kind == 4), dtype=np.int32)[at]
        starts = k != 1
        starts[0] = True
        starts[1:] |= (g[1:] != g[:-1]) | (k[:-1] != 1)
        # A full stop between letters parts words only before a capital.
        c = codes[at]
        low = lower[c]
        starts[1:] |= (at[1:] - at[:-1] > 1) & (low[1:] != c[1:])
        lows.append(low)
        firsts.append(starts)
        ends.append(np.flatnonzero(k == 5) + base)
        base += len(at)
    if not lows:
        return np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(1, np.int64)
    return np.concatenate(lows), np.concatenate(firsts), np.concatenate(([0], np.concatenate(ends) + 1))


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all windows of q (a power of two) codes."""
    h = codes.astype(np.uint64)
    base, d = _BASE, 1
    while d < q:
        if len(h) <= d:
            return np.zeros(0, dtype=np.uint64)
        h = h[:-d] * np.uint64(base) + h[d:]
        base = (base * base + 2) & 0xFFFFFFFFFFFFFFFF | 1
        h ^= h >> np.uint64(29)
        d *= 2
    return h


def sentences_of(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, word starts) of the sentences of an item that have any."""
    parts = [text[a:b] for a, b in units_of([text])[0]]
    low, starts, off = fold(parts)
    return [(low[a : b - 1], starts[a : b - 1]) for a, b in zip(off.tolist(), off[1:].tolist()) if b - 1 > a]


_SENTENCES = "item_id bigint, sentences int, codes binary, starts binary"


def _divided(b: pa.RecordBatch) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in _SENTENCES.split(", ")}
    for item, text in zip(str_col(b, "item_id"), str_col(b, "text")):
        own = sentences_of(text)
        for codes, starts in own:
            for c, v in zip(out.values(), (item, len(own), codes.astype("<u4").tobytes(), starts.tobytes())):
                c.append(v)
    return out


class Index:
    """Samples of the sentences of a block of items."""

    def __init__(self, item: np.ndarray, total: np.ndarray, codes: list[np.ndarray], starts: list[np.ndarray]) -> None:
        """``item``, ``total``: of each sentence, its item and how many that has."""
        self.item_ids, first, self.owner = np.unique(item, return_index=True, return_inverse=True)
        self.need = -(-total[first] // 2)
        size = np.fromiter((len(c) for c in codes), dtype=np.int64, count=len(codes))
        self.off = np.concatenate(([0], np.cumsum(size)))
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        word = np.concatenate(starts) if starts else np.zeros(0, bool)
        if len(word):
            word[self.off[:-1]] = True
        self.word = word
        at = np.append(np.flatnonzero(word), len(word))
        longest, words = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        if len(codes):
            of = np.searchsorted(self.off, at[:-1], "right") - 1
            np.maximum.at(longest, of, np.diff(at))
            words = np.bincount(of, minlength=len(codes))
        self.longest, self.one_word = int(longest.max(initial=1)), words == 1
        # q and the least number of shared samples of each sentence.
        self.bound = np.zeros(len(codes), dtype=np.int64)
        self.q = np.zeros(len(codes), dtype=np.int64)
        for least in (2, 1):
            for q in QS:
                step = q // 2
                m = np.where(size >= q, (size - q) // step + 1, 0)
                lost = np.where(self.one_word, 0, -(-(longest + q - 1) // step))
                ok = (self.q == 0) & (m - lost >= least)
                self.q[ok], self.bound[ok] = q, (m - lost)[ok]
        self.weak = np.flatnonzero(self.q == 0)
        self.weak_of = np.bincount(self.owner[self.weak], minlength=len(self.item_ids)) if len(codes) else np.zeros(0, np.int64)
        self.post: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in QS:
            own = np.flatnonzero(self.q == q)
            if not len(own):
                continue
            h = grams(self.codes, q)
            m = (size[own] - q) // (q // 2) + 1
            sent = np.repeat(own, m)
            pos = (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)) * (q // 2)
            hs = h[self.off[sent] + pos]
            order = np.argsort(hs, kind="stable")
            hs = hs[order]
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[(hs >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.post[q] = (hs, sent[order], pos[order], bits)

    def sentence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.off[k], self.off[k + 1]
        return self.codes[a:b], self.word[a:b]

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, sentence, place in the sentence) of every shared sample."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, (h, sent, pos, bits), base in ((q, p, b) for q, p in self.post.items() for b in range(0, len(codes), _STEP)):
            g = grams(codes[base : base + _STEP + q - 1], q)
            at = np.flatnonzero(bits[(g >> np.uint64(64 - _BITS)).view(np.int64)])
            g = g[at]
            at += base
            lo, hi = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
            n = hi - lo
            ok = n > 0
            at, lo, n = at[ok], lo[ok], n[ok]
            if len(at):
                row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append((np.repeat(at, n), sent[row], pos[row]))
        if not out:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def index_of(items: list[tuple[int, str]]) -> Index:
    """The index of a few items, made in place."""
    rows = [(i, len(own), c, w) for i, t in items for own in [sentences_of(t)] for c, w in own]
    return Index(np.asarray([r[0] for r in rows], dtype=np.int64), np.asarray([r[1] for r in rows], dtype=np.int64), [r[2] for r in rows], [r[3] for r in rows])


@lru_cache(maxsize=1)
def _block(path: str, k: int) -> Index:
    t = loaded(f"{path}/block={k}", ["item_id", "sentences", "codes", "starts"])
    codes = [np.frombuffer(x, dtype="<u4") for x in t.column("codes").to_pylist()]
    starts = [np.frombuffer(x, dtype=bool) for x in t.column("starts").to_pylist()]
    return Index(t.column("item_id").to_numpy(), t.column("sentences").to_numpy().astype(np.int64), codes, starts)


def bands(index: Index, codes: np.ndarray, word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence, first diagonal, width) of every band that meets its
    sentence's bound."""
    place, sent, pos = index.hits(codes)
    z = np.zeros(0, dtype=np.int64)
    if not len(place):
        return z, z, z, z
    doc = np.searchsorted(off, place, "right") - 1
    begins = np.flatnonzero(word)
    half = np.full(len(off), max(BAND, index.longest), dtype=np.int64)  # by document
    np.maximum.at(half, np.searchsorted(off, begins, "right") - 1, np.diff(np.append(begins, len(codes))))
    shift = int(np.diff(index.off).max())  # so that no diagonal is negative
    diagonal = place - off[doc] - pos + shift
    n = len(index.off)
    most = int(diagonal.max()) // BAND + 2
    band = diagonal // half[doc]
    # A sample counts once in each of the two bands that its diagonal lies in.
    group = np.concatenate(((doc * most + band), (doc * most + band - 1)))
    keep = np.concatenate((np.ones(len(band), dtype=bool), band > 0))
    key = _distinct(group[keep] * n + np.concatenate((sent, sent))[keep], np.concatenate((pos, pos))[keep])
    key, count = np.unique(key, return_counts=True)
    s = key % n
    ok = count >= index.bound[s]
    key, s = key[ok], s[ok]
    d, b = key // n // most, key // n % most
    return d, s, b * half[d] - shift, 2 * half[d]


def _distinct(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The keys of distinct (key, pos)."""
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    return key[new]


def aligned(d: np.ndarray, begins: np.ndarray, s: np.ndarray, sw: np.ndarray, lo: int, hi: int, one_word: bool) -> bool:
    """Banded alignment: whether ``s`` is held by document ``d`` (its word starts
    ``begins``) with a part of it on a diagonal of ``lo`` to ``hi``."""
    n, m = len(s), len(d)
    lo, hi = max(lo, -n), min(hi, m)
    if hi <= lo:
        return False
    window = np.zeros(hi - lo + n - 1, dtype=np.uint32)
    a, b = max(lo, 0), min(hi + n - 1, m)
    window[a - lo : b - lo] = d[a:b]
    differ = np.lib.stride_tricks.sliding_window_view(window, n) != s
    clean = ~differ.any(axis=1)
    head = np.where(clean, n, differ.argmax(axis=1))  # equal from the start on
    tail = np.where(clean, n, differ[:, ::-1].argmax(axis=1))
    edge = lambda i: i == m or 0 <= i < m and begins[min(np.searchsorted(begins, i), len(begins) - 1)] == i
    for x in (np.flatnonzero(clean) + lo).tolist():
        if edge(x) and edge(x + n):
            return True
    if one_word:
        return False
    cuts = [*np.flatnonzero(sw).tolist(), n]
    same = lambda i, rest: i >= 0 and i + len(rest) <= m and np.array_equal(d[i : i + len(rest)], rest)
    after = lambda i: int(begins[j]) if (j := np.searchsorted(begins, i, "right")) < len(begins) else m
    for x in (np.flatnonzero(head >= cuts[1]) + lo).tolist():
        if not edge(x):
            continue
        for a, b in zip(cuts[1:], [*cuts[2:], n]):
            if a > head[x - lo] or a == n:
                break
            if x + a >= m or not edge(x + a):
                continue
            y = after(x + a)  # one word of the document is passed over
            for rest in (s[b:], s[a:]):
                if same(y, rest) and edge(y + len(rest)):
                    return True
    for x in (np.flatnonzero(tail >= n - cuts[-2]) + lo).tolist():
        if not edge(x + n):
            continue
        for a, b in zip(cuts[-3::-1], cuts[-2::-1]):
            if n - b > tail[x - lo]:
                break
            if x + b <= 0 or not edge(x + b):
                continue
            y = int(begins[np.searchsorted(begins, x + b) - 1])
            for first in (s[:a], s[:b]) if a else (s[:a],):
                if same(y - len(first), first) and edge(y - len(first)):
                    return True
    return False


def leaks(index: Index, texts: list[str | None], folded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """(text number, item id) of every leak."""
    codes, word, off = folded or fold(texts)
    if not len(index.item_ids):
        return []
    d, s, lo, width = bands(index, codes, word, off)
    k = len(index.item_ids)
    pair = np.unique(d * len(index.off) + s)
    key, n = np.unique(pair // len(index.off) * k + index.owner[pair % len(index.off)], return_counts=True)
    key = key[n + index.weak_of[key % k] >= index.need[key % k]]
    free = np.flatnonzero(index.weak_of >= index.need)  # items of hardly any other sentences
    if len(free):
        key = np.unique(np.concatenate((key, (np.arange(len(off) - 1)[:, None] * k + free).ravel())))
    want = np.isin(d * k + index.owner[s], key)
    held: dict[int, set[int]] = {}
    begins: dict[int, np.ndarray] = {}

    def holds(i: int, j: int, a: int, b: int) -> bool:
        doc = codes[off[i] : off[i + 1] - 1]
        if i not in begins:
            begins[i] = np.flatnonzero(word[off[i] : off[i + 1] - 1])
        return len(begins[i]) > 0 and aligned(doc, begins[i], *index.sentence(j), a, b, bool(index.one_word[j]))

    for i, j, a, w in zip(*(x[want].tolist() for x in (d, s, lo, width))):
        own = held.setdefault(i * k + int(index.owner[j]), set())
        if j not in own and holds(i, j, a, a + w):
            own.add(j)
    if len(index.weak):
        weak: dict[int, list[int]] = {}
        for j in index.weak.tolist():
            weak.setdefault(int(index.owner[j]), []).append(j)
        for f in key.tolist():
            i, item = divmod(f, k)
            own = held.setdefault(f, set())
            for j in weak.get(item, []):
                if len(own) < index.need[item] and holds(i, j, -len(codes), len(codes)):
                    own.add(j)
    return [(f // k, int(index.item_ids[f % k])) for f, own in held.items() if len(own) >= index.need[f % k]]


def leaked_items(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of every document (doc_id, text) that holds at least
    half of an item's (item_id, text) sentences."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0  # one number
    blocks = max(1, -(-size // block_chars))
    sentences = map_texts(rows, _divided, _SENTENCES, ["text"]).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    path = stored(sentences.repartition(blocks, "block"), "block")
    table = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch:
            ids = [i for b in held for i in str_col(b, "doc_id")]
            folded = fold([t for b in held for t in str_col(b, "text")])
            held.clear()
            got = [(ids[i], item) for k in range(blocks) for i, item in leaks(_block(path, k), ids, folded)]
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], pa.int64()) for j in (0, 1)], names=["doc_id", "item_id"])

        for b in sliced(batches, ["text"]):
            held.append(b)
            if blocks == 1 or sum(x.nbytes for x in held) > ROUND_BYTES:
                yield found()
        if held:
            yield found()

    return table.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()
