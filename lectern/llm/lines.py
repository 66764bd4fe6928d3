"""Problem 3: lines repeated across the documents of one site.

Every line has a key, equal for lines that look the same, and a variant, the line
as stored.  Per site each variant's documents are a compressed bitmap (containers
of 2^12 ids: a sorted array of 16-bit numbers while sparse, 512 bytes of bits when
dense), built by each map task for its own lines, so a site or a line that holds a
third of all rows arrives at the shuffle as a few containers.  A variant's
bitmaps of all tasks are united, then the bitmaps of a line's variants; lines of
fewer than ``min_docs`` documents go at once, the others' exact cardinalities are
compared with the thresholds.

A line is deleted where its document stands in its bitmap: lines and bitmaps that
passed meet by container, which holds 2^12 ids however many sites and lines there
are.  Before they are dealt by container, lines are let through by a bit set of
2^20 key hashes, whose false hits the bitmaps refuse.  Texts are read once and
never shuffled.

Defined results: lines end at LF or CRLF; a line without letters is never a
case; a document without site can only repeat its own title; a NULL text has no
lines; a document or book given twice counts once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrowio import cut, map_texts, str_col
from lectern.llm.look import COMMON, Looks, consistent_form, looks_of

MIN_DOCS = 5
MIN_SHARE = 0.05
#: Ids of a container, as bits, and how many of them take more room as an array.
CONTAINER = 12
DENSE = 1 << (CONTAINER - 4)
#: Bits of the set of keys that lines are let through by.
KEY_BITS = 20

_LINE_END = re.compile(r"\r?\n")
_DROP = re.compile(r"[\d\s]+")
_LETTER = re.compile(r"[^\W\d_]")


def line_key(line: str | None, looks: Looks = COMMON) -> bytes | None:
    """128-bit key equal for lines that look the same but for letter case,
    figures and white space; None for lines without a letter."""
    if not line or not _LETTER.search(line):
        return None
    form = _DROP.sub("", (line if line.isascii() else consistent_form(line, looks)).casefold())
    return xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")) if form else None


def lines_of(text: str) -> list[str]:
    return _LINE_END.split(text)


# --- containers ---------------------------------------------------------------
def pack(low: np.ndarray) -> bytes:
    """A container of sorted distinct numbers."""
    if len(low) < DENSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << CONTAINER, dtype=bool)
    bits[low] = True
    return np.packbits(bits).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) == 1 << (CONTAINER - 3):
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8))).astype(np.int64)
    return np.frombuffer(data, dtype="<u2").astype(np.int64)


def unite(parts: list[bytes]) -> bytes:
    if len(parts) == 1:
        return parts[0]
    return pack(np.unique(np.concatenate([unpack(p) for p in parts])))


# --- lines of documents -----------------------------------------------------------
#: A line with a letter: its number, key and variant (a hash of it as stored).
_LINE = np.dtype([("no", "<i4"), ("key", "V16"), ("variant", "<i8")])


def _lined(b: pa.RecordBatch, looks: Looks) -> dict[str, list]:
    """One slim row a document; its lines packed into one value."""
    seen: dict[str, tuple[bytes, int] | None] = {}
    out: dict[str, list] = {"doc_id": [], "book_id": [], "lines": []}
    for doc, book, text in zip(str_col(b, "doc_id"), str_col(b, "book_id"), str_col(b, "text")):
        if doc is None:
            continue
        rows = []
        for n, line in enumerate(lines_of(text or ""), 1):
            if line not in seen:
                k = line_key(line, looks)
                seen[line] = None if k is None else (k, xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63))
            if (found := seen[line]) is not None:
                rows.append((n, *found))
        out["doc_id"].append(doc)
        out["book_id"].append(book)
        out["lines"].append(np.array(rows, dtype=_LINE).tobytes())
    return out


def site_lines(docs: DataFrame, books: DataFrame) -> DataFrame:
    """(doc_id, site, title_key, lines) of every document.

    ``docs``: doc_id, book_id, text; ``books``: book_id, site, title.  Only the
    slim rows of documents are joined with the books, never the texts.
    """
    rows = docs.select("doc_id", "book_id", "text")
    looks = looks_of(docs.sparkSession)
    lines = map_texts(rows, lambda b: _lined(b, looks), "doc_id bigint, book_id bigint, lines binary", ["text"])
    own = map_texts(
        books.select(F.col("book_id").cast("bigint").alias("book_id"), "site", "title"),
        lambda b: {"book_id": str_col(b, "book_id"), "site": str_col(b, "site"), "title_key": [line_key(t, looks) for t in str_col(b, "title")]},
        "book_id bigint, site string, title_key binary",
        ["title"],
    )
    own = own.where("book_id is not null").dropDuplicates(["book_id"])
    return lines.join(own, "book_id", "left").select("doc_id", "site", "title_key", "lines")


# --- bitmaps of lines -------------------------------------------------------------
_PARTS = "site string, key binary, variant bigint, hi bigint, bits binary"
_PART_SCHEMA = pa.schema([("site", pa.string()), ("key", pa.binary()), ("variant", pa.int64()), ("hi", pa.int64()), ("bits", pa.binary())])
_BITMAPS = "site string, key binary, hi bigint, bits binary, n bigint"
_BITMAP_SCHEMA = pa.schema([("site", pa.string()), ("key", pa.binary()), ("hi", pa.int64()), ("bits", pa.binary()), ("n", pa.int64())])
_ROWS = 20_000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of each variant of one task, let go when many are held."""
    held: dict[tuple, list[int]] = defaultdict(list)
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for (site, key, variant, hi), low in held.items():
            rows.append((site, key, variant, hi, pack(np.unique(np.asarray(low, dtype=np.int64)) if len(low) > 1 else np.asarray(low, dtype=np.int64))))
            if len(rows) >= _ROWS:
                yield _batch(rows, _PART_SCHEMA)
                rows = []
        if rows:
            yield _batch(rows, _PART_SCHEMA)
        held.clear()

    for b in batches:
        for site, doc, data in zip(str_col(b, "site"), str_col(b, "doc_id"), str_col(b, "lines")):
            rows = np.frombuffer(data, dtype=_LINE)
            hi, low = doc >> CONTAINER, doc & ((1 << CONTAINER) - 1)
            for key, variant in zip(rows["key"].tolist(), rows["variant"].tolist()):
                held[site, key, variant, hi].append(low)
            n += len(rows)
        if n > 300_000:
            yield from flush()
            n = 0
    yield from flush()


def _united(least: int):  # noqa: ANN202
    """Unite the parts of each variant, then the variants of each line, which come
    sorted next to each other; lines of fewer than ``least`` documents go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = at = variant = None
        parts: list[bytes] = []  # of the variant at hand
        variants: list[bytes] = []  # of the container at hand
        waiting: list[tuple] = []  # containers of the line at hand
        total = 0
        out: list[tuple] = []

        def end_variant() -> None:
            nonlocal parts
            if parts:
                variants.append(unite(parts))
            parts = []

        def end_container() -> None:
            nonlocal variants, total
            end_variant()
            if variants:
                bits = unite(variants)
                n = len(unpack(bits))
                total += n
                waiting.append((*line, at, bits, n))
            variants = []
            if total >= least:
                out.extend(waiting)
                waiting.clear()

        for b in batches:
            for site, key, v, hi, bits in zip(*(str_col(b, c) for c in ("site", "key", "variant", "hi", "bits"))):
                if (site, key) != line or hi != at:
                    end_container()
                    if (site, key) != line:
                        waiting.clear()
                        total = 0
                    line, at, variant = (site, key), hi, v
                elif v != variant:
                    end_variant()
                    variant = v
                parts.append(bits)
                if len(parts) > 64:
                    parts = [unite(parts)]
            if len(out) >= _ROWS:
                yield _batch(out, _BITMAP_SCHEMA)
                out.clear()
        end_container()
        if out:
            yield _batch(out, _BITMAP_SCHEMA)

    return run


def line_bitmaps(rows: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(site, key, hi, bits, n): the documents of each line of each site that
    stands in ``least`` documents or more."""
    parts = rows.where("site is not null").select("site", "doc_id", "lines").mapInArrow(_build, _PARTS)
    near = parts.repartition("site", "key").sortWithinPartitions("site", "key", "hi", "variant")
    return near.mapInArrow(_united(least), _BITMAPS)


# --- deletion ---------------------------------------------------------------------
def _hash(key: bytes) -> int:
    return int.from_bytes(key[:4], "little") & ((1 << KEY_BITS) - 1)


def _let_through(batches: Iterator[pa.RecordBatch], keys: bytes) -> Iterator[pa.RecordBatch]:
    """Lines that may be repeated, by the bit set of keys, and documents' titles."""
    may = np.unpackbits(np.frombuffer(keys, dtype=np.uint8)).astype(bool)
    for b in batches:
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, site, title, data in zip(*(str_col(b, c) for c in ("doc_id", "site", "title_key", "lines"))):
            rows = np.frombuffer(data, dtype=_LINE)
            found = rows["key"].tolist()
            heads = np.frombuffer(data, dtype=np.uint8).reshape(-1, _LINE.itemsize)[:, 4:8].copy().view("<u4")[:, 0] & ((1 << KEY_BITS) - 1)
            own = [title is not None and k == title for k in found]
            for i in np.flatnonzero(may[heads] | np.asarray(own, dtype=bool)).tolist():
                for c, v in zip(cols, (doc >> CONTAINER, doc, site, int(rows["no"][i]), found[i], own[i])):
                    c.append(v)
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["hi", "doc_id", "site", "line_no", "key", "title"])


def _looked_up(lines: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """Lines of one container whose documents stand in their bitmaps."""
    sets = {(s, k): set(unpack(x).tolist()) for s, k, x in zip(*(bitmaps.column(c).to_pylist() for c in ("site", "key", "bits")))}
    docs, numbers = [], []
    for doc, site, no, key, title in zip(*(lines.column(c).to_pylist() for c in ("doc_id", "site", "line_no", "key", "title"))):
        if title or (doc & ((1 << CONTAINER) - 1)) in sets.get((site, key), ()):
            docs.append(doc)
            numbers.append(no)
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "line_no": pa.array(numbers, pa.int32())})


def repeated_lines(docs: DataFrame, books: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, line_no) of every line to be removed."""
    rows = cut(site_lines(docs, books))
    bitmaps = cut(line_bitmaps(rows, min_docs))
    sizes = rows.where("site is not null").groupBy("site").agg(F.count_distinct("doc_id").alias("docs"))
    often = (
        bitmaps.groupBy("site", "key").agg(F.sum("n").alias("n"))
        .join(sizes, "site")
        .where((F.col("n") >= min_docs) & (F.col("n") >= min_share * F.col("docs")))
        .select("site", "key")
    )
    kept = cut(bitmaps.join(often, ["site", "key"], "left_semi").select("site", "key", "hi", "bits"))
    # At most 2^KEY_BITS numbers, whatever the size of the data.
    may = np.zeros(1 << KEY_BITS, dtype=bool)
    may[kept.select("key").distinct().mapInArrow(_hashes, "hash int").distinct().toArrow().column("hash").to_numpy()] = True
    keys = np.packbits(may).tobytes()
    lines = rows.mapInArrow(lambda b: _let_through(b, keys), "hi bigint, doc_id bigint, site string, line_no int, key binary, title boolean")
    return lines.groupBy("hi").cogroup(kept.groupBy("hi")).applyInArrow(_looked_up, "doc_id bigint, line_no int").distinct()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted({_hash(k) for k in str_col(b, "key")}), type=pa.int32())], names=["hash"])


def without_lines(docs: DataFrame, removals: DataFrame, out: str = "clean_text") -> DataFrame:
    """``docs`` (doc_id, text, ...) with the text less its removed lines; other
    lines and their ends stay as they are."""
    per_doc = removals.groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))  # no more than the document's lines
    parts = F.split("text", r"(?<=\n)")
    rest = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i + 1)), "")
    return docs.join(per_doc, "doc_id", "left").withColumn(out, F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest)).drop("_gone")
