"""Names of artifacts and downloads as Column expressions.

A part that isn't safe (empty, absolute, with backslash, ``.`` or ``..``, a
negative number) gives NULL, so unsafe rows can be filtered or reported.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import WS_CHARS, one_spaced, strip


# Characters that a download's name can't hold.
UNSAFE = r'[\x00-\x1f\x7f/\\:*?"<>|]+'


def _c(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def number(x: Column | str | int, width: int = 4) -> Column:
    """A number of at least ``width`` digits, unlike ``lpad`` never cut."""
    x = _c(x)
    return F.when(x >= 0, F.format_string(f"%0{width}d", x.cast("bigint")))


def book_dir(book: Column | str) -> Column:
    return F.when(_c(book) >= 0, F.concat(F.lit("books/"), _c(book).cast("string")))


def safe_extension(ext: Column) -> Column:
    return F.when(ext.rlike(r"^[A-Za-z0-9]+\z"), ext)


def source_path(book: Column | str, name: Column | str) -> Column:
    """The uploaded file, by its own name."""
    return F.concat(book_dir(book), F.lit("/"), upload_name(name))


def filtered_path(book: Column | str) -> Column:
    return F.concat(book_dir(book), F.lit("/filtered.txt"))


def cleaned_path(book: Column | str) -> Column:
    return F.concat(book_dir(book), F.lit("/cleaned.txt"))


def structured_path(book: Column | str) -> Column:
    """Chapters stored as one JSON array."""
    return F.concat(book_dir(book), F.lit("/structured-chapters.json"))


def staged_path(book: Column | str, job: Column | str, index: Column | str) -> Column:
    """A chapter of a division that isn't in force yet."""
    j = _c(job)
    return F.concat(book_dir(book), F.lit("/chapters/split-"), F.when(j >= 0, j.cast("string")), F.lit("/"), number(index), F.lit(".txt"))


def segment_url(chapter: Column | str, segment: Column | str) -> Column:
    """Where a segment's sound is downloaded."""
    return F.concat(F.lit("/api/chapters/"), _c(chapter).cast("string"), F.lit("/audio/segments/"), _c(segment).cast("string"), F.lit("/download"))


def speech_source(asked: Column, translation: Column | str) -> Column:
    """What is spoken: the translation where asked for and there, else the chapter."""
    return F.when((asked == "translation") & _c(translation).isNotNull(), "translation").otherwise("chapter")


def text_source(translation: Column | str, text: Column | str) -> Column:
    """Path of the text to work on: the translation's unless NULL or empty."""
    return F.coalesce(F.nullif(_c(translation), F.lit("")), _c(text))


def chapter_path(book: Column | str, index: Column | str) -> Column:
    return F.concat(book_dir(book), F.lit("/chapters/"), number(index), F.lit(".txt"))


def translation_path(book: Column | str, index: Column | str, segment: Column | str) -> Column:
    return F.concat(book_dir(book), F.lit("/translations/"), number(index), F.lit("-"), number(segment), F.lit(".txt"))


def audio_path(book: Column | str, index: Column | str, segment: Column | str, ext: Column | None = None, job: Column | str | None = None) -> Column:
    """With a job, in the job's own folder."""
    ext = safe_extension(F.lit("mp3") if ext is None else ext)
    base = F.concat(book_dir(book), F.lit("/audio/"), number(index))
    plain = F.concat(base, F.lit("-"), number(segment), F.lit("."), ext)
    if job is None:
        return plain
    j = _c(job)
    own = F.concat(base, F.lit("/jobs/"), F.when(j >= 0, j.cast("string")), F.lit("/"), number(segment), F.lit("."), ext)
    return F.when(j.isNull(), plain).otherwise(own)


def safe_relative(path: Column | str) -> Column:
    """The path if it is a safe relative one, else NULL.  Inner ``.`` and empty
    parts vanish when a path is read, so only a leading ``..`` part, or one
    anywhere, or a path of nothing but dots, is refused."""
    p = _c(path)
    bad = (p == "") | p.contains("\\") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|\z)") | p.rlike(r"^[./]*\z")
    return F.when(~bad, p)


def upload_name(name: Column | str) -> Column:
    """Last part of a path of either kind of slash; NULL if there is none."""
    last = F.element_at(F.split(F.replace(_c(name), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(~last.isin("", ".", ".."), last)


def download_part(value: Column | str, fallback: Column, limit: int = 120) -> Column:
    """A part of a download's name: control and reserved characters as blanks."""
    s = one_spaced(F.regexp_replace(_c(value), UNSAFE, " "))
    s = F.when(F.coalesce(s, F.lit("")) == "", fallback).otherwise(s)
    return F.rtrim(F.left(s, F.lit(limit)), F.lit(WS_CHARS))


def download_name(book: Column | str, chapter: Column | str, index: Column | str, ext: str = "wav") -> Column:
    second = download_part(chapter, F.concat(F.lit("chapter-"), (_c(index) + 1).cast("string")))
    return F.concat(download_part(book, F.lit("book")), F.lit(" - "), second, F.lit("." + ext))


def file_format(name: Column | str) -> Column:
    """Lower-case suffix without the dot; NULL where there is none."""
    return F.nullif(F.lower(F.regexp_extract(_c(name), r"[^/]\.([^./]+)\z", 1)), F.lit(""))


def stem(name: Column | str) -> Column:
    base = F.element_at(F.split(_c(name), "/"), -1)
    return F.when(base.rlike(r"^.+\.[^.]+\z"), F.regexp_extract(base, r"^(.+)\.[^.]+\z", 1)).otherwise(base)


def title_or_number(*titles: Column | str, index: Column | str, form: str = "第 %d 章") -> Column:
    """First title that isn't blank, else a numbered one."""
    return F.coalesce(*(F.nullif(strip(_c(t)), F.lit("")) for t in titles), F.format_string(form, (_c(index) + 1).cast("bigint")))


def concat_list_escaped(path: Column | str) -> Column:
    """Path as written into a list of files to be concatenated."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("\\\\"))
    return F.replace(p, F.lit("'"), F.lit("'\\''"))
