"""Size-bounded segments and their reassembly."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip


def bounded_pieces(text: str | None, limit: int) -> list[str]:
    """Greedy pieces of at most ``limit`` characters that make up the stripped
    text: each ends behind the last blank line within the limit, else behind
    the last line end, else at the limit."""
    if limit <= 0:
        raise ValueError("limit must be greater than zero")
    rest = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    out, at, n = [], 0, len(rest)
    while n - at > limit:
        gap = rest.rfind("\n\n", at, at + limit + 1)
        if gap >= 0 and gap + 2 - at <= limit:
            end = gap + 2
        else:
            line = rest.rfind("\n", at, at + limit)
            end = line + 1 if line >= 0 else at + limit
        out.append(rest[at:end])
        at = end
    if at < n:
        out.append(rest[at:])
    return out


def segment_rows(df: DataFrame, key: str, text: str, limit: int, trim: bool = False) -> DataFrame:
    """(key, segment_index, segment_text); ``trim`` strips the pieces and drops
    blank ones, after which they no longer make up the text."""
    schema = df.select(F.col(key).alias(key)).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, index, pieces = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = bounded_pieces(t, limit)
                if trim:
                    got = [p for p in (p.strip() for p in got) if p]
                keys += [k] * len(got)
                index += range(len(got))
                pieces += got
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=b.schema.field(0).type), pa.array(index, pa.int64()), pa.array(pieces, pa.string())], names=[key, "segment_index", "segment_text"])

    return df.select(key, text).mapInArrow(run, f"{key} {schema}, segment_index bigint, segment_text string")


def stripped_pieces(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def reassembled(df: DataFrame, keys: list[str], order: str, text: str, sep: str = "\n\n", out: str = "text") -> DataFrame:
    """Texts of each key in order, NULL as an empty one.

    The result of a key is one value, put together by one task: a key's rows are
    bounded by what is one text (the pieces of a chapter or job), not by the table."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r.t), sep).alias(out))
