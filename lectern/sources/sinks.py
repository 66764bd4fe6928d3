"""Writers: texts, chapter files and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import safe_relative


def write_texts(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a table of (path, text); partitions alone where given."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def archive_manifest(entries: DataFrame) -> DataFrame:
    """Entries (archive, position, path) with the name in the archive, and an
    error for paths that would leave it."""
    name = safe_relative("path")
    return entries.withColumn("archive_name", name).withColumn("error", F.when(name.isNull(), F.concat(F.lit("Unsafe archive path: "), F.col("path"))))


def archives(entries: DataFrame) -> DataFrame:
    """(archive, content) of entries (archive, position, path, content): one
    deflated ZIP per archive, its safe entries in order of position.  Each
    archive is a file and so has to fit one task; archives are independent."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in frame.sort_values("position")[["archive_name", "content"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), bytes(content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"archive": [frame["archive"].iloc[0]], "content": [buf.getvalue()]})

    ok = archive_manifest(entries).where("error is null").select("archive", "position", "archive_name", "content")
    return ok.groupBy("archive").applyInPandas(run, "archive string, content binary")


def written_one_by_one(df: DataFrame, root: str) -> DataFrame:
    """Write rows (path, content) as files below a shared folder (any that Arrow can
    open: file, hdfs, s3, gs), by the tasks themselves; gives (path, bytes, error).
    A repeated task writes the same files again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        at, where = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"]):
                try:
                    full = f"{where}/{p}"
                    at.create_dir(full.rpartition("/")[0], recursive=True)
                    with at.open_output_stream(full) as out:
                        out.write(bytes(content))
                    rows.append((p, len(content), None))
                except OSError as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "bytes", "error"]).astype({"bytes": "Int64"})

    safe = df.where(safe_relative("path").isNotNull())
    return safe.select("path", "content").mapInPandas(run, "path string, bytes bigint, error string")
