"""Cleaning of noisy prose, line by line, as Column expressions.

Every cleaner turns a text into (text, removed_lines).  All are row-local: a
chain of them is one projection, with neither shuffle nor Python.  A text from
which nothing is removed comes out unchanged byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WS, let, lines_with_ends, strip, unix_lines

# What counts as noise.
INVISIBLES = "\u200b\u200c\u200d\ufeff\u2060"
PADDING = rf"[{WS}:：\-—_=*【】\[\]（）()《》<>|]*"
DOMAINS = "com|net|org|cn|cc|vip|xyz|top|info"
ADDRESS_LINE = rf"(?diu)^{PADDING}(?:https?://[^{WS}]+|www\.[^{WS}]+|[A-Za-z0-9-]+\.(?:{DOMAINS})(?:/[^{WS}]*)?){PADDING}\z"
WATERMARK = r"(?diu)(本书来自|扫码关注|关注公众号|微信公众号|水印|更多精彩|下载地址|小说下载|仅供.*交流)"
DECORATION = rf"^[{WS}*\-=~_#·•…—–]{{6,}}\z"
ADVERT = r"(?iu)(广告|发布页|防盗|盗版|来源|书源|推广)"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
MARKS_AFTER = "，。！？；：、,.!?;:）】》」』"
MARKS_OPEN = "（【《「『"
MARKS_FULL = "，。！？；：、"


def is_watermark(line: Column) -> Column:
    return let(strip(line), lambda s: (s != "") & (s.rlike(WATERMARK) | s.rlike(ADDRESS_LINE)))


def is_decoration(line: Column) -> Column:
    return strip(line).rlike(DECORATION)


def is_short_noise(line: Column, most: int = 20) -> Column:
    """A short line that would be noise if it came again and again."""
    return let(strip(line), lambda s: (s != "") & (F.length(s) <= most) & (s.rlike(ADDRESS_LINE) | s.rlike(WATERMARK) | s.rlike(DECORATION) | s.rlike(ADVERT)))


def _result(text: Column, lines: Column, kept: Column) -> Column:
    removed = (F.size(lines) - F.size(kept)).cast("bigint")
    return F.struct(F.when(removed == 0, text).otherwise(F.array_join(kept, "")).alias("text"), removed.alias("removed_lines"))


def _without(text: Column, gone: Callable[[Column], Column]) -> Column:
    return let(lines_with_ends(text), lambda lines: let(F.filter(lines, lambda x: ~gone(x)), lambda kept: _result(text, lines, kept)))


def without_watermarks(text: Column) -> Column:
    return _without(text, is_watermark)


def without_decoration(text: Column) -> Column:
    return _without(text, is_decoration)


def without_repeats(text: Column, least: int = 3, most: int = 20) -> Column:
    """Short noise lines that stand ``least`` times in the text."""

    def often(noise: Column) -> Column:
        # Equal lines stand next to each other; the one ``least - 1`` later is equal too.
        later = lambda n, i: F.get(noise, i + (least - 1)) == n
        return F.array_distinct(F.filter(noise, later))

    def rest(lines: Column, gone: Column) -> Column:
        return let(F.filter(lines, lambda x: ~F.array_contains(gone, strip(x))), lambda kept: _result(text, lines, kept))

    def of_lines(lines: Column) -> Column:
        noise = F.array_sort(F.transform(F.filter(lines, lambda x: is_short_noise(x, most)), strip))
        return let(let(noise, often), lambda gone: F.when(F.size(gone) == 0, _result(text, lines, lines)).otherwise(rest(lines, gone)))

    return let(lines_with_ends(text), of_lines)


def tidy_line(line: Column) -> Column:
    """Blanks of a line: runs as one, none between Chinese signs and marks."""
    s = strip(F.regexp_replace(line, r"[ \t\f\x0B\x{a0}\x{3000}]+", " "))
    for pattern in (f"(?<=[{HAN}]) (?=[{HAN}])", f"(?<=[{HAN}]) (?=[{MARKS_AFTER}])", f"(?<=[{MARKS_OPEN}]) (?=[{HAN}])", f"(?<=[{MARKS_FULL}]) (?=[{HAN}])"):
        s = F.regexp_replace(s, pattern, "")
    return s


def tidy_spacing(text: Column) -> Column:
    def of_lines(lines: Column) -> Column:
        clean = strip(F.regexp_replace(F.array_join(F.transform(lines, tidy_line), "\n"), r"\n{3,}", "\n\n"))
        return let(clean, lambda c: F.struct(c.alias("text"), _fewer(lines, c).cast("bigint").alias("removed_lines")))

    return let(F.split(F.translate(unix_lines(text), INVISIBLES, ""), "\n"), of_lines)


def _fewer(lines: Column, clean: Column) -> Column:
    return F.when(clean == "", F.size(lines)).otherwise(F.greatest(F.lit(0), F.size(lines) - F.size(F.split(clean, "\n"))))


#: Cleaners by name; more can be registered.
CLEANERS: dict[str, Callable[[Column], Column]] = {
    "remove_watermarks": without_watermarks,
    "normalize_spacing": tidy_spacing,
    "remove_repeated_noise_lines": without_repeats,
    "remove_decorative_characters": without_decoration,
}


def clean_with(*steps: str) -> Callable[[Column], Column]:
    """Text -> text by cleaners in order."""

    def run(k: int, now: Column) -> Column:
        return now if k == len(steps) else let(CLEANERS[steps[k]](now), lambda r: run(k + 1, r["text"]))

    return lambda text: let(text, lambda t: run(0, t))


def cleaned(df: DataFrame, text: str, steps: Iterable[str], out: str = "clean_text", stats: str = "clean_stats") -> DataFrame:
    """``df`` with the text after all steps in order, and an array of
    (operation, before_chars, after_chars, removed_lines), one of each step.

    The chain is one expression in which the result of each step is bound once,
    so the optimiser cannot repeat a step for each use of its result.
    """
    steps = list(steps)
    for s in steps:
        if s not in CLEANERS:
            raise ValueError(f"Unknown text cleaning operation: {s}")
    kind = "array<struct<operation:string,before_chars:bigint,after_chars:bigint,removed_lines:bigint>>"

    def stat(name: str, before: Column, r: Column) -> Column:
        return F.struct(
            F.lit(name).alias("operation"), F.length(before).cast("bigint").alias("before_chars"),
            F.length(r["text"]).cast("bigint").alias("after_chars"), r["removed_lines"].alias("removed_lines"),
        )

    def run(k: int, now: Column, done: list[Column]) -> Column:
        if k == len(steps):
            return F.struct(now.alias("text"), F.array(*done).cast(kind).alias("stats"))
        return let(CLEANERS[steps[k]](now), lambda r: run(k + 1, r["text"], [*done, stat(steps[k], now, r)]))

    keep = [c for c in df.columns if c not in (out, stats)]
    chain = let(F.col(text), lambda t: run(0, t, []))
    return df.select(*keep, chain.alias("_r")).select(*keep, F.col("_r.text").alias(out), F.col("_r.stats").alias(stats))
