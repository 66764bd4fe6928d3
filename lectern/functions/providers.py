"""Per-row external functions (translation, speech), injected by the caller.

A provider is any picklable ``Callable[[list[str]], list]`` over a batch of
prompts, giving texts or bytes.  A batch is called once; if the call fails, or
gives another number of results, its rows are called one by one, each with its own
retries, and an exception marks that row failed with the message.  Providers have
to be idempotent, as tasks may be repeated.
"""

from __future__ import annotations

import io
import time
import wave
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Provider = Callable[[list[str]], list]

PROVIDERS: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def echo_translation(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for tests: a mark before the text."""
    return [f"译文：{p}" for p in prompts]


def silent_speech(prompts: list[str]) -> list[bytes]:
    """Deterministic stand-in for tests: eight silent frames, mono, 16-bit, 8 kHz."""
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(16))
    return [buf.getvalue()] * len(prompts)


register("fake", echo_translation)
register("fake speech", silent_speech)


def doubling(first: float = 1.0, most: float = 30.0) -> Callable[[int], float]:
    """Waits that double, as between calls of a translation model."""
    return lambda attempt: min(most, first * 2**attempt)


def linear(step: float = 0.1) -> Callable[[int], float]:
    """Waits that grow evenly, as between calls of a speech model."""
    return lambda attempt: step * (attempt + 1)


class Fatal(Exception):
    """Raised by a provider where another try can't help."""


def apply_provider(
    df: DataFrame, key: str, prompt: str, provider: Provider | str, retries: int = 2, wait: float | Callable[[int], float] = 0.1, batch: int = 64, result: str = "string"
) -> DataFrame:
    """(key, status, result, error) of each row's prompt; ``result`` is its type.

    ``wait``: seconds before each retry by its number from 0, or the first of
    waits that double."""
    call = PROVIDERS[provider] if isinstance(provider, str) else provider
    pause = wait if callable(wait) else doubling(wait)
    kind = df.schema[key].dataType.simpleString()
    value = pa.binary() if result == "binary" else pa.string()

    def one(prompt: str) -> tuple:
        for k in range(max(0, retries) + 1):
            try:
                got = call([prompt])
                if len(got) != 1:
                    raise ValueError("the provider gave no single result")
                return got[0], None
            except Fatal as e:
                return None, str(e)[:1000]
            except Exception as e:  # noqa: BLE001 - becomes the row's error
                if k >= retries:
                    return None, str(e)[:1000]
                time.sleep(pause(k))
        return None, "not called"

    def several(prompts: list[str]) -> list[tuple]:
        if len(prompts) > 1:
            try:
                got = call(prompts)
                if len(got) == len(prompts):
                    return [(r, None) for r in got]
            except Exception:  # noqa: BLE001, S110 - each row tells its own error below
                pass
        return [one(p) for p in prompts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = [p if p is not None else "" for p in b.column(1).to_pylist()]
            got = [x for i in range(0, len(prompts), batch) for x in several(prompts[i : i + batch])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(["completed" if e is None else "failed" for _, e in got]), pa.array([r for r, _ in got], value), pa.array([e for _, e in got], pa.string())],
                names=[key, "status", "result", "error"],
            )

    return df.select(key, prompt).mapInArrow(run, f"{key} {kind}, status string, result {result}, error string")
