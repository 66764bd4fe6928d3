"""Problem 2: cutting oversized texts by agglomerative merging.

A text above its limit is first broken at every boundary there is (blank line,
line end, sentence end, clause mark, blank, and inside a longer run by force)
into atoms.  Adjacent atoms are held in a heap by the strength of the boundary
between them, and the weakest boundaries are merged first while the combined
size plus the overlap fits.  What stays apart are the cuts.

Sizes count code points of the text after CRLF has become LF and outer white
space is dropped.  Each piece after the first repeats the end of the one before,
from a natural boundary, of at most ``overlap`` characters.  Defined results:
NULL and blank texts have no pieces; a text within the limit is one piece; the
pieces without their overlaps make up the text exactly.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrowio import map_texts, str_col
from lectern.llm.units import units_of

OVERLAP = 60
FORCED, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
#: Marks that a run may be cut after.
MARKS = ".!?;,:…。！？；，、："
_RUN = re.compile(rf"[^\s{re.escape(MARKS)}]+")
_EDGE = re.compile(rf"\n\s*\n\s*|\n[^\S\n]*|[{re.escape(MARKS)}]+[”“»«」』\"’'）)\]]*(?:[^\S\n]+)?|[^\S\n]+")


def trimmed(text: str) -> str:
    return text.replace("\r\n", "\n").strip()


def has_forced_run(text: str, limit: int) -> bool:
    return any(m.end() - m.start() > limit for m in _RUN.finditer(text))


def _hard_cuts(text: str, a: int, b: int, limit: int) -> list[int]:
    """Cuts inside a run above the limit, never before a combining mark."""
    cuts = []
    while b - a > limit:
        c = a + limit
        while c > a + 1 and (unicodedata.combining(text[c]) or text[c] in "‍︎️"):
            c -= 1
        if c == a + 1:
            c = a + limit
        cuts.append(c)
        a = c
    return cuts


def atoms(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Ends of the atoms and the strength of the boundary at each end."""
    sentence = {e for _, e in units_of([text])[0]}
    at: dict[int, int] = {}
    for m in _EDGE.finditer(text):
        s = m[0]
        e = m.end()
        if s[0] == "\n":
            at[e] = PARAGRAPH if s.count("\n") > 1 else LINE
        elif m.start() in sentence or len(s.rstrip()) + m.start() in sentence:
            at[e] = SENTENCE
        elif s[0] in MARKS:
            # Not inside figures, hosts and the like.
            at[e] = CLAUSE if s[-1].isspace() or not s[0].isascii() else FORCED
        else:
            at[e] = BLANK
    ends, strength, a = [], [], 0
    for e in [*sorted(x for x in at if x < len(text)), len(text)]:
        for c in _hard_cuts(text, a, e, limit):
            ends.append(c)
            strength.append(FORCED)
        ends.append(e)
        strength.append(at.get(e, PARAGRAPH))
        a = e
    return ends, strength


def cores(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces without overlap, as (start, end) in the trimmed text."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    overlap = min(overlap, limit // 2)
    ends, strength = atoms(text, limit)
    k = len(ends)
    start = [0, *ends[:-1]]
    end = list(ends)
    left = list(range(-1, k - 1))
    right = [*range(1, k), -1]
    alive = [True] * k
    heap = [(strength[i], end[i + 1] - start[i], i, i + 1) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and right[i] == j and end[j] - start[i] == size):
            continue
        if size + (overlap if start[i] else 0) > limit:
            continue
        end[i], alive[j] = end[j], False
        strength[i] = strength[j]
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
            heapq.heappush(heap, (strength[i], end[right[i]] - start[i], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (strength[left[i]], end[i] - start[left[i]], left[i], i))
    return [(start[i], end[i]) for i in range(k) if alive[i]]


def pieces(text: str | None, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core start, end) of every piece of the trimmed text."""
    t = trimmed(text) if text else ""
    out = []
    for a, b in cores(t, limit, overlap):
        most = min(overlap, limit - (b - a), a)
        begin = a
        if out and most > 0:
            begin = a - most
            if begin > out[-1][0]:
                # From the first natural boundary within reach, else a plain one.
                m = re.search(r"[\n.!?。！？；;，,、:：…]\s*|\s+", t[begin - 1 : a - 1])
                if m and begin - 1 + m.end() < a:
                    begin += m.end() - 1
            else:
                begin = a
        out.append((begin, a, b))
    return out


_SCHEMA = "item_kind string, item_id bigint, piece_no int, piece string, overlap int, cut_kind string"


def _cut(b: pa.RecordBatch) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in _SCHEMA.split(", ")}
    for kind, i, text, limit in zip(*(str_col(b, c) for c in ("item_kind", "item_id", "text", "size_limit"))):
        if text is None or i is None or not limit or limit < 2:
            continue
        t = trimmed(text)
        got = pieces(text, limit)
        how = "whole" if len(got) < 2 else "forced" if has_forced_run(t, limit) else "natural"
        for n, (begin, a, end) in enumerate(got):
            out["item_kind"].append(kind)
            out["item_id"].append(i)
            out["piece_no"].append(n)
            out["piece"].append(t[begin:end])
            out["overlap"].append(a - begin)
            out["cut_kind"].append(how)
    return out


def cut_texts(items: DataFrame, only_oversized: bool = False) -> DataFrame:
    """Pieces of items (item_kind, item_id, text, size_limit).

    ``only_oversized`` drops items within their limit before Python sees them;
    trimming only shortens, so none above the limit is lost.
    """
    rows = items.select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), "text", F.col("size_limit").cast("int").alias("size_limit"))
    if only_oversized:
        rows = rows.where(F.length("text") > F.col("size_limit"))
    got = map_texts(rows, _cut, _SCHEMA, ["text"])
    return got.where("cut_kind <> 'whole'") if only_oversized else got
