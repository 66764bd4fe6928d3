"""PCM audio as arrays of 16-bit samples, frame by frame interleaved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds a silence may last, and the highest sample of a silent frame.
MAX_SILENCE_MS = 1200
SILENT = 96


def peaks(samples: Column, channels: Column, buckets: int = 600) -> Column:
    """Highest absolute sample of each bucket of frames, as a share of full
    scale; NULL without frames.  The last bucket may be short."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    count = F.greatest(F.lit(1), F.least(F.lit(buckets), frames))
    per = F.greatest(F.lit(1), F.ceil(frames / count).cast("int"))

    def peak(i: Column) -> Column:
        own = F.slice(samples, i * per * channels + 1, F.least(per, frames - i * per) * channels)
        top = F.array_max(F.transform(own, lambda s: F.abs(s.cast("int"))))
        return F.bround(F.least(F.lit(1.0), top / F.lit(32768.0)), 4)

    n = F.ceil(frames / per).cast("int")
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), peak))


def is_silent(frame: Column, threshold: int = SILENT) -> Column:
    return F.forall(frame, lambda s: F.abs(s.cast("int")) <= threshold)


def silence_budget(rate: Column, ms: int = MAX_SILENCE_MS) -> Column:
    return F.greatest(F.lit(1), (rate * F.lit(ms / 1000)).cast("int"))


def collapsed_samples(samples: np.ndarray, channels: int, rate: int, ms: int = MAX_SILENCE_MS, threshold: int = SILENT) -> np.ndarray | None:
    """Samples with every silent run cut to its first ``ms``; None if nothing
    was cut."""
    frames = samples[: len(samples) // channels * channels].reshape(-1, channels)
    if not len(frames):
        return None
    silent = (np.abs(frames.astype(np.int32)) <= threshold).all(axis=1)
    at = np.arange(len(frames))
    # Place within the run: distance from the last frame that isn't silent.
    since = at - np.maximum.accumulate(np.where(silent, -1, at))
    keep = ~silent | (since <= max(1, int(rate * (ms / 1000))))
    return None if keep.all() else frames[keep].reshape(-1)


def collapse_silence(
    df: DataFrame, samples: str = "samples", channels: str = "channels", rate: str = "sample_rate", ms: int = MAX_SILENCE_MS, threshold: int = SILENT
) -> DataFrame:
    """``df`` with long silences of its samples cut, vectorised by Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = df.schema
    arrow = to_arrow_schema(schema)
    i = df.columns.index(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(k) for k in range(b.num_columns)]
            out = []
            there = []
            for s, c, r in zip(b.column(i), b.column(b.schema.get_field_index(channels)).to_pylist(), b.column(b.schema.get_field_index(rate)).to_pylist()):
                there.append(s.is_valid)
                own = np.asarray(s.values.to_numpy(zero_copy_only=False)) if s.is_valid else np.zeros(0, np.int16)
                got = collapsed_samples(own, c, r, ms, threshold) if s.is_valid and c and r else None
                out.append(own if got is None else got)
            ends = np.cumsum([0, *(len(x) for x in out)])
            offsets = pa.array([*ends[:-1].tolist(), int(ends[-1])], pa.int32(), mask=np.append(~np.asarray(there, dtype=bool), False))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int16)).cast(arrow.field(i).type.value_type)
            cols[i] = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def merged(df: DataFrame, keys: list[str], order: str, samples: str = "samples") -> DataFrame:
    """Samples of each key in order; only keys whose parts share channels,
    sample width and rate.  A key's sound is one value, put together by one task:
    its parts are bounded by the length of one sound."""
    params = F.struct("channels", "sample_width", "sample_rate")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(samples).alias("s"))))
    got = df.groupBy(*keys).agg(F.min(params).alias("_a"), F.max(params).alias("_b"), F.flatten(F.transform(parts, lambda p: p.s)).alias(samples), F.count("*").alias("parts"))
    return got.where(F.col("_a") == F.col("_b")).select(*keys, "_a.*", samples, "parts")


def merged_audio(df: DataFrame, keys: list[str], order: str, ms: int = MAX_SILENCE_MS, threshold: int = SILENT) -> DataFrame:
    """Sound of each key's parts in order, long silences of each part collapsed
    first; keys whose parts differ in channels, width or rate give no sound.

    A merged sound is one value, so a key's parts have to fit a task: the bound is
    the length of one sound, not the number of rows of the table."""
    return merged(collapse_silence(df, ms=ms, threshold=threshold), keys, order)
