"""Whole pipelines made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.providers import Provider, apply_provider
from lectern.operators.chapters import chapter_rows, chapters_of, cleaned_chapters, first_of_two, stored_chapters
from lectern.operators.cleaning import clean_with, cleaned
from lectern.operators.segments import reassembled, segment_rows

STEPS = ("normalize_spacing", "remove_watermarks", "remove_repeated_noise_lines", "remove_decorative_characters")


def books_to_chapters(books: DataFrame, steps: tuple[str, ...] = STEPS, size: int = 6000) -> DataFrame:
    """(book_id, chapter_index, title, text, char_count, paragraph_count): a
    projection and an explode, no shuffle."""
    clean = cleaned(books.select("book_id", "full_text"), "full_text", steps)
    return chapter_rows(clean.withColumn("_chapters", chapters_of(F.col("clean_text"), size)), "_chapters", "book_id")


def stored_books_to_chapters(books: DataFrame, steps: tuple[str, ...] = STEPS, size: int = 6000) -> DataFrame:
    """The like of books (book_id, stored, source, full_text): stored chapters and
    those of the source file (arrays of title and text) are cleaned each by itself, a
    text as a whole before it is divided."""
    clean = clean_with(*steps)
    c = F.col
    chosen = first_of_two(cleaned_chapters(stored_chapters(c("stored")), clean), cleaned_chapters(c("source"), clean), chapters_of(clean(c("full_text")), size))
    return chapter_rows(books.select("book_id", chosen.alias("_chapters")), "_chapters", "book_id")


def segment_jobs(texts: DataFrame, key: str, text: str, limit: int = 1200, nothing: str = "chapter has no translatable text") -> tuple[DataFrame, DataFrame]:
    """(segments, jobs): the pieces of each text in order, and per text their number,
    or an error where there are none."""
    pieces = segment_rows(texts, key, text, limit, trim=True)
    sizes = pieces.groupBy(key).agg(F.count("*").alias("total_units"))
    jobs = texts.select(key).distinct().join(sizes, key, "left")
    failed = F.col("total_units").isNull()
    return pieces, jobs.select(
        key, F.coalesce("total_units", F.lit(0)).alias("total_units"), F.when(failed, "failed").otherwise("pending").alias("status"), F.when(failed, nothing).alias("error_message")
    )


def translated(texts: DataFrame, key: str, text: str, provider: Provider | str, limit: int = 1200, sep: str = "\n\n") -> DataFrame:
    """(key, text) of texts cut, translated piece by piece and put together in
    order; only keys all of whose pieces came out."""
    pieces = segment_rows(texts, key, text, limit, trim=True).withColumn("piece_id", F.struct(key, "segment_index"))
    done = apply_provider(pieces.select(F.to_json("piece_id").alias("id"), "segment_text"), "id", "segment_text", provider)
    schema = pieces.select("piece_id").schema["piece_id"].dataType
    rows = done.withColumn("p", F.from_json("id", schema)).select("p.*", "status", "result")
    whole = rows.groupBy(key).agg(F.bool_and(F.col("status") == "completed").alias("ok")).where("ok").select(key)
    return reassembled(rows.join(whole, key, "left_semi"), [key], "segment_index", "result", sep)
