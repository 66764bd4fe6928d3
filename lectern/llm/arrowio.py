"""Arrow plumbing shared by the text operators.

Python runs where a rule needs a whole text; everything that groups or joins
stays in the JVM.  Batches are cut again by text size, so one partition full of
very long texts needs no more memory than one full of short ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.partitioning import cut, drop_at_exit, shared_dir, spread
from lectern.shipping import ship

#: Characters handed to a text function at a time.
BATCH_CHARS = 1_500_000


def sliced(batches: Iterator[pa.RecordBatch], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text columns hold about
    ``BATCH_CHARS`` bytes (a single longer row stays whole)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = sum(b.column(t).nbytes for t in texts)
        step = max(1, int(n * BATCH_CHARS / max(size, 1)))
        if step >= n:
            yield b
        else:
            for i in range(0, n, step):
                yield b.slice(i, step)


def map_texts(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, list]],
    schema: str,
    texts: list[str],
) -> DataFrame:
    """``mapInArrow`` with size-cut batches; ``fn`` returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    out = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, texts):
            cols = fn(b)
            arrays = [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], type=f.type) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, parsed)


def stored(df: DataFrame, *by: str) -> str:
    """Write a table to the shared folder, in parts by columns where given, and
    give its path: what tasks open themselves, piece by piece."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    drop_at_exit(df.sparkSession, path)
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return path


def loaded(path: str, columns: list[str]) -> pa.Table:
    """A part of a stored table, read by a task; empty where there is no part."""
    from pyarrow import dataset, fs

    at, where = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    if at.get_file_info(where).type == fs.FileType.NotFound:
        return pa.table({c: pa.array([], pa.binary() if c in ("codes", "starts") else pa.int64()) for c in columns})
    return dataset.dataset(where, filesystem=at, format="parquet").to_table(columns=columns)


_TEXTS = {"text", "full_text", "source_text", "result_text"}


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str, deal: bool = True) -> DataFrame:
    """A table; one with texts is dealt to all cores if it has few partitions,
    unless a filter comes first."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*cols) if cols else df
    return spread(df) if deal and _TEXTS & set(cols) else df


def str_col(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


__all__ = ["BATCH_CHARS", "F", "cut", "loaded", "map_texts", "read", "shared_dir", "sliced", "spread", "stored", "str_col"]
