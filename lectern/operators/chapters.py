"""Chapters of a book's text, by headings or by size, as array expressions.

Row-local like the cleaners: a text becomes an array of (title, text), which is
exploded only where rows are wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WS, char_count, let, paragraph_count, strip, unix_lines

# Forms of headings.
NUMERAL = r"[零〇一二三四五六七八九十百千万两\p{Nd}]+"
ROMAN = "[IVXLCDM]+"
HEADING = (
    rf"(?diu)^(?:第{NUMERAL}[{WS}]*[章节回卷部篇].*|卷[{WS}]*{NUMERAL}.*"
    rf"|(?:Chapter|Section|Part|Book)[{WS}]+(?:\p{{Nd}}+|{ROMAN})(?![\p{{L}}\p{{N}}_]).*"
    rf"|(?:\p{{Nd}}+|{ROMAN})[.)、][{WS}]+[^{WS}].*"
    r"|(?:序|序章|序言|前言|楔子|尾声|后记))\z"
)
LONGEST = 80
FRONT_TITLE = "前言"

ARRAY = "array<struct<title:string,text:string>>"


def is_heading(line: Column) -> Column:
    return let(strip(line), lambda s: (s != "") & (F.length(s) <= LONGEST) & s.rlike(HEADING))


def _sections(lines: Column, heads: Column) -> Column:
    """Sections of lines by the (1-based) places of their headings."""
    n = F.size(heads)

    def body(first: Column, count: Column) -> Column:
        return strip(F.array_join(F.slice(lines, first, F.greatest(count, F.lit(0))), "\n"))

    def section(here: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1), F.size(lines) + 1)
        return F.struct(strip(F.get(lines, here - 1)).alias("title"), body(here + 1, end - here - 1).alias("text"))

    front = F.when(n >= 2, body(F.lit(1), F.get(heads, F.lit(0)) - 1))
    first = lambda f: F.when(F.coalesce(f, F.lit("")) != "", F.array(F.struct(F.lit(FRONT_TITLE).alias("title"), f.alias("text")))).otherwise(F.array().cast(ARRAY))
    return F.concat(let(front, first), F.transform(heads, section))


def by_headings(text: Column) -> Column:
    """Sections from heading to heading.  What stands before the first becomes
    a section of its own if there are two headings or more."""

    def of_lines(lines: Column) -> Column:
        flags = F.transform(lines, lambda x, i: F.when(is_heading(x), i + 1))
        return let(F.filter(flags, lambda i: i.isNotNull()), lambda heads: _sections(lines, heads))

    return let(F.split(text, "\n"), of_lines)


def by_size(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, numbered."""
    if size <= 0:
        raise ValueError("size must be greater than zero")
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    piece = lambda i: F.struct(F.format_string("第 %d 段", i + 1).alias("title"), F.substring(text, i * size + 1, F.lit(size)).alias("text"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), piece)).otherwise(F.array().cast(ARRAY))


def chapters_of(text: Column, size: int = 6000) -> Column:
    """By headings where that gives two chapters or more, else by size."""
    by_heads = lambda t: let(by_headings(t), lambda found: F.when(F.size(found) >= 2, found).otherwise(by_size(t, size)))
    return let(strip(unix_lines(text)), by_heads)


def first_of_two(*candidates: Column) -> Column:
    """The first array of at least two chapters, else the last candidate."""
    out = candidates[-1]
    for c in reversed(candidates[:-1]):
        out = F.when(F.size(c) >= 2, c).otherwise(out)
    return out


def stored_chapters(json: Column) -> Column:
    """Chapters of a JSON array of {title, text}: items without text dropped;
    an untitled one is numbered by its place in the array."""
    items = F.from_json(json, "array<struct<title:string,text:string>>")
    numbered = F.transform(items, lambda x, i: F.struct(F.coalesce(F.nullif(strip(x.title), F.lit("")), F.format_string("第 %d 章", i + 1)).alias("title"), x.text.alias("text")))
    return F.coalesce(F.filter(numbered, lambda x: strip(F.coalesce(x.text, F.lit(""))) != ""), F.array().cast(ARRAY))


def chapters_json(chapters: Column) -> Column:
    """JSON array of the chapters that have a text."""
    return F.to_json(F.filter(chapters, lambda x: strip(x.text) != ""))


def chapters_to_divide(stored: Column, source: Column, text: Column, size: int = 6000) -> Column:
    """Chapters of a book in order of precedence: those stored as JSON, those of its
    source file, each if there are two or more, else its text divided."""
    return first_of_two(stored_chapters(stored), source, chapters_of(text, size))


def cleaned_chapters(chapters: Column, clean: Callable[[Column], Column]) -> Column:
    """Each chapter cleaned by itself (``clean``: text -> text), so what repeats is
    counted within a chapter, not within the book."""
    return F.transform(chapters, lambda c: F.struct(c.title.alias("title"), clean(c.text).alias("text")))


def chapter_rows(df: DataFrame, chapters: str, *keep: str) -> DataFrame:
    """One row per chapter: index, title, text and its metadata.

    The outer form of the generator keeps the optimiser from inferring a filter
    that would compute the whole array once more; it gives a NULL row for a text
    without chapters, which is dropped."""
    rows = df.select(*keep, F.posexplode_outer(chapters).alias("chapter_index", "_c")).where("chapter_index is not null")
    return rows.select(
        *keep, F.col("chapter_index").cast("bigint").alias("chapter_index"), F.col("_c.title").alias("title"), F.col("_c.text").alias("text"),
        char_count(F.col("_c.text")).alias("char_count"), paragraph_count(F.col("_c.text")).alias("paragraph_count"),
    )
