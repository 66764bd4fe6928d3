"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import align, langid, leaks, lines, look, packing, pairs, pieces, units  # noqa: F401 - a missing library is told here, not by a query
from lectern.llm.arrowio import map_texts, read, str_col


# --- 1: texts that look the same ----------------------------------------------
def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.look import look_prints

    chapters = look_prints(read(spark, sf_dir, "parsed_chapters", "chapter_id", "text"), "chapter_id", "text")
    books = look_prints(read(spark, sf_dir, "parsed_books", "book_id", "full_text"), "book_id", "full_text")
    return chapters.withColumn("item_kind", F.lit("chapter")).unionByName(books.withColumn("item_kind", F.lit("book")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.look import same_looking_pairs

    return same_looking_pairs(_prints(spark, sf_dir)).select("item_kind", "left_id", "right_id").distinct()


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an item with its class: what p1_found lists as pairs."""
    from lectern.llm.look import look_classes

    return look_classes(_prints(spark, sf_dir))


def p1_consistent_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.look import consistent_texts

    df = read(spark, sf_dir, "parsed_chapters", "chapter_id", "text")
    return consistent_texts(df, "text").select("chapter_id", "consistent_text")


# --- 2: pieces of oversized texts -----------------------------------------------
#: Limits of chapters and of the segments of each kind of job.
CHAPTER_LIMIT = 6000
SEGMENT_LIMITS = {"translate": 1200, "tts": 900}


def _sized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = read(spark, sf_dir, "parsed_chapters", "chapter_id", "text").select(
        F.lit("chapter").alias("item_kind"), F.col("chapter_id").alias("item_id"), "text", F.lit(CHAPTER_LIMIT).alias("size_limit")
    )
    limit = F.create_map(*(F.lit(x) for kv in SEGMENT_LIMITS.items() for x in kv))
    jobs = read(spark, sf_dir, "jobs", "id", "kind").distinct().select(F.col("id").alias("job_id"), limit[F.col("kind")].alias("size_limit")).where("size_limit is not null")
    # A segment not above the smallest limit cannot be a case: it needs no join.
    segments = read(spark, sf_dir, "segments", "id", "job_id", "source_text", deal=False).where(F.length("source_text") > min(SEGMENT_LIMITS.values()))
    segments = segments.join(jobs, "job_id").select(F.lit("segment").alias("item_kind"), F.col("id").alias("item_id"), F.col("source_text").alias("text"), "size_limit").distinct()
    return chapters.unionByName(segments)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pieces import cut_texts

    return cut_texts(_sized_items(spark, sf_dir), only_oversized=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).select("item_kind", "item_id", "cut_kind").distinct()


# --- 3: repeated lines of a site ------------------------------------------------
def _chapters_and_books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "parsed_chapters", "chapter_id", "book_id", "text").withColumnRenamed("chapter_id", "doc_id")
    books = read(spark, sf_dir, "books", "id", "site", "title").withColumnRenamed("id", "book_id")
    return docs, books


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.lines import repeated_lines

    return repeated_lines(*_chapters_and_books(spark, sf_dir)).withColumnRenamed("doc_id", "chapter_id")


def p3_clean_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.lines import repeated_lines, without_lines

    docs, books = _chapters_and_books(spark, sf_dir)
    return without_lines(docs, repeated_lines(docs, books)).select(F.col("doc_id").alias("chapter_id"), "clean_text")


# --- 4: sentences that render each other -----------------------------------------
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the texts gives both the votes and the words."""
    from lectern.llm.align import _COLUMNS, aligned, dealt, prepared
    from lectern.llm.arrowio import cut
    from lectern.llm.pairs import first_defect, read_pairs, result_model, targets_of, votes_of

    segments = read(spark, sf_dir, "segments", "id", "job_id", "status", "source_text", "result_text", "error_message")
    targets = targets_of(read(spark, sf_dir, "jobs", "id", "kind", "options"))
    rows = read_pairs(segments, result_model(segments, targets), prepared, _COLUMNS)
    votes = cut(votes_of(rows, targets))
    sound = votes.where("status = 'completed'").join(first_defect(votes).withColumnRenamed("segment_id", "id"), "id", "left_anti")
    return aligned(dealt(rows, sound.select("id", "sl", "target_lang")))


# --- 5: sentence units -----------------------------------------------------------
def units_table(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, start_pos, end_pos) of every unit of a text column."""
    from lectern.llm.units import unit_arrays

    def fn(b):  # noqa: ANN001, ANN202
        who, start, end = unit_arrays(str_col(b, text))
        return {item_id: b.column(b.schema.get_field_index(item_id)).take(pa.array(who)), "start_pos": start, "end_pos": end}

    return map_texts(df.select(item_id, text).where(F.col(item_id).isNotNull()), fn, f"{item_id} bigint, start_pos int, end_pos int", [text])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows delivered twice are identical: they fall together as slim rows.
    rows = read(spark, sf_dir, "segments", "id", "source_text").withColumnRenamed("id", "segment_id")
    return units_table(rows, "segment_id", "source_text").distinct()


def p5_chapter_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_table(read(spark, sf_dir, "parsed_chapters", "chapter_id", "text"), "chapter_id", "text")


# --- 6: broken pairs ------------------------------------------------------------------
def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pairs import pair_votes

    segments = read(spark, sf_dir, "segments", "id", "job_id", "status", "source_text", "result_text", "error_message")
    return pair_votes(segments, read(spark, sf_dir, "jobs", "id", "kind", "options"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pairs import first_defect

    return first_defect(_votes(spark, sf_dir))


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pairs import defects

    return defects(_votes(spark, sf_dir)).select(F.col("id").alias("segment_id"), "defect", F.round("posterior", 4).alias("posterior"))


# --- 7: containers of tokens -------------------------------------------------------------
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import pack, token_counts

    return pack(token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full and how even the containers are, with the smallest documents put in
    the tightest rooms (as in p7_packed) and with the cost alone."""
    from lectern.llm.arrowio import cut
    from lectern.llm.packing import TIGHT_BELOW, pack, packing_report, token_counts

    counts = cut(token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER))
    rows = [packing_report(pack(counts, tight_below=n)).withColumn("tight_below", F.lit(n)) for n in (TIGHT_BELOW, 0)]
    return rows[0].unionByName(rows[1])


# --- 8: evaluation texts in the corpus ---------------------------------------------
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.leaks import leaked_items

    return leaked_items(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "eval_items", "item_id", "text"))


# --- 9: languages --------------------------------------------------------------------
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.langid import language_cases

    return language_cases(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.langid import language_segments

    return language_segments(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.langid import document_languages

    return document_languages(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
