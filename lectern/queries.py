"""Queries of the core operators over the test tables, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import display, jsons, names, text
from lectern.functions.providers import apply_provider
from lectern.functions.text import WS
from lectern.operators import audio, chapters, cleaning, relational, segments
from lectern.operators.partitioning import shared_dir, spread
from lectern.shipping import ship
from lectern.sources import sinks
from lectern.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str, once: bool = False) -> DataFrame:
    """A table; ``once`` for those in which rows are delivered twice."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*cols) if cols else df
    df = df.distinct() if once else df
    return spread(df) if "text" in cols or "full_text" in cols else df


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- SQL pieces (RE2 spelling of the same classes) --------------------------------
_ENDS = r"\n\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}\r"


def s_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def s_unix(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def s_lines(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s)[^{_ENDS}]*(?:\\r\\n|[{_ENDS}])|[^{_ENDS}]+')"


def s_null(x: str) -> str:
    return f"nullif({s_strip(x)}, '')"


# The patterns of cleaning.py and chapters.py in RE2's spelling.
_PAD = rf"[{WS}:：\-—_=*【】\[\]（）()《》<>|]*"
_ADDRESS = rf"(?i)^{_PAD}(?:https?://[^{WS}]+|www\.[^{WS}]+|[A-Za-z0-9-]+\.(?:{cleaning.DOMAINS})(?:/[^{WS}]*)?){_PAD}$"
_MARK = "(?i)(本书来自|扫码关注|关注公众号|微信公众号|水印|更多精彩|下载地址|小说下载|仅供.*交流)"
_DECOR = rf"^[{WS}*\-=~_#·•…—–]{{6,}}$"


def s_watermark(x: str) -> str:
    return f"({s_strip(x)} <> '' AND (regexp_matches({s_strip(x)}, '{_MARK}') OR regexp_matches({s_strip(x)}, '{_ADDRESS}')))"


def s_decor(x: str) -> str:
    return f"regexp_matches({s_strip(x)}, '{_DECOR}')"


def s_noise(x: str) -> str:
    t = s_strip(x)
    return f"({t} <> '' AND length({t}) <= 20 AND (regexp_matches({t}, '{_ADDRESS}') OR regexp_matches({t}, '{_MARK}') OR regexp_matches({t}, '{_DECOR}') OR regexp_matches({t}, '(?i)(广告|发布页|防盗|盗版|来源|书源|推广)')))"


def _line_filter_sql(src: str, key: str, col: str, gone: str) -> str:
    return f"""
WITH l AS (SELECT {key}, {col} AS t, {s_lines(col)} AS ls FROM {src}),
f AS (SELECT {key}, t, ls, list_filter(ls, lambda x: NOT {gone}) AS kept FROM l)
SELECT {key}, md5(CASE WHEN len(kept) = len(ls) THEN t ELSE array_to_string(kept, '') END) AS text_md5,
       CAST(len(ls) - len(kept) AS BIGINT) AS removed_lines FROM f"""


def _cleaned(df: DataFrame, key: str, col: str, fn: Callable[[Column], Column]) -> DataFrame:
    return df.select(key, fn(F.col(col)).alias("r")).select(key, F.md5(F.col("r.text").cast("binary")).alias("text_md5"), F.col("r.removed_lines").alias("removed_lines"))


# --- sources -----------------------------------------------------------------------
@query(f"SELECT doc_id, {s_strip('list_filter(' + s_lines('text') + f', lambda x: {s_strip(chr(120))} <> {chr(39)*2})[1]')} AS first_line FROM documents")
def src_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.first_line("text").alias("first_line"))


@query(
    r"""SELECT id AS book_id, nullif(lower(regexp_extract(original_filename, '[^/]\.([^./]+)$', 1)), '') AS suffix,
    CASE WHEN regexp_matches(original_filename, '(?s)^.+\.[^.]+$') THEN regexp_extract(original_filename, '(?s)^(.+)\.[^.]+$', 1) ELSE original_filename END AS stem,
    coalesce(lower(regexp_extract(original_filename, '[^/]\.([^./]+)$', 1)) IN ('txt', 'epub'), false) AS supported FROM books"""
)
def src_file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "books", "id", "original_filename")
    suffix = names.file_format("original_filename")
    return df.select(F.col("id").alias("book_id"), suffix.alias("suffix"), names.stem("original_filename").alias("stem"), F.coalesce(suffix.isin("txt", "epub"), F.lit(False)).alias("supported"))


@query(
    f"""SELECT book_id, md5({s_strip(s_unix('full_text'))}) AS text_md5, CAST(length({s_strip(s_unix('full_text'))}) AS BIGINT) AS chars FROM parsed_books"""
)
def src_text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.strip(text.unix_lines("full_text"))
    return table(spark, sf_dir, "parsed_books", "book_id", "full_text").select("book_id", F.md5(t.cast("binary")).alias("text_md5"), long(F.length(t)).alias("chars"))


@query(
    """WITH j AS (SELECT book_id, to_json(list({'title': title, 'text': text} ORDER BY chapter_index)) AS doc FROM parsed_chapters GROUP BY book_id)
    SELECT c.book_id, CAST(c.rn - 1 AS BIGINT) AS chapter_index, c.title, md5(c.text) AS text_md5 FROM (
      SELECT book_id, coalesce(nullif("""
    + s_strip("title")
    + """, ''), '第 ' || CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) AS VARCHAR) || ' 章') AS title, text,
      row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) AS rn FROM parsed_chapters WHERE """
    + s_strip("text")
    + " <> '') c"
)
def src_stored_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters written as a JSON array per book and read again."""
    parts = F.array_sort(F.collect_list(F.struct("chapter_index", "title", "text")))
    book = table(spark, sf_dir, "parsed_chapters", "book_id", "chapter_index", "title", "text").groupBy("book_id").agg(parts.alias("p"))
    doc = book.select("book_id", chapters.chapters_json(F.transform("p", lambda x: F.struct(x.title.alias("title"), x.text.alias("text")))).alias("doc"))
    rows = doc.select("book_id", F.posexplode_outer(chapters.stored_chapters(F.col("doc"))).alias("i", "x")).where("i is not null")
    return rows.select("book_id", long("i").alias("chapter_index"), "x.title", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


# --- scalar text functions -----------------------------------------------------------
@query(_line_filter_sql("documents", "doc_id", "text", s_watermark("x")))
def str_remove_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", cleaning.without_watermarks)


@query(_line_filter_sql("parsed_chapters", "chapter_id", "text", s_decor("x")))
def str_decorative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(table(spark, sf_dir, "parsed_chapters", "chapter_id", "text"), "chapter_id", "text", cleaning.without_decoration)


@query(
    f"""WITH l AS (SELECT doc_id, text AS t, {s_lines('text')} AS ls FROM documents),
n AS (SELECT doc_id, t, ls, list_transform(list_filter(ls, lambda x: {s_noise('x')}), lambda x: {s_strip('x')}) AS noise FROM l),
o AS (SELECT doc_id, t, ls, list_filter(list_distinct(noise), lambda k: len(list_filter(noise, lambda m: m = k)) >= 2) AS often FROM n),
f AS (SELECT doc_id, t, ls, list_filter(ls, lambda x: NOT list_contains(often, {s_strip('x')})) AS kept FROM o)
SELECT doc_id, md5(CASE WHEN len(kept) = len(ls) THEN t ELSE array_to_string(kept, '') END) AS text_md5, CAST(len(ls) - len(kept) AS BIGINT) AS removed_lines FROM f"""
)
def str_repeated_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", lambda c: cleaning.without_repeats(c, 2))


def _tidy_sql(x: str) -> str:
    han = cleaning.HAN
    s = s_strip(f"regexp_replace({x}, '[ \\t\\f\\x0B\\x{{a0}}\\x{{3000}}]+', ' ', 'g')")
    for a, b in ((f"[{han}]", f"[{han}]"), (f"[{han}]", f"[{cleaning.MARKS_AFTER}]"), (f"[{cleaning.MARKS_OPEN}]", f"[{han}]"), (f"[{cleaning.MARKS_FULL}]", f"[{han}]")):
        for _ in range(2):
            s = f"regexp_replace({s}, '({a}) ({b})', '\\1\\2', 'g')"
    return s


@query(
    f"""WITH p AS (SELECT chapter_id, string_split(translate({s_unix('text')}, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(8288), ''), chr(10)) AS ls FROM parsed_chapters),
c AS (SELECT chapter_id, ls, {s_strip("regexp_replace(array_to_string(list_transform(ls, lambda x: " + _tidy_sql('x') + "), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean FROM p)
SELECT chapter_id, md5(clean) AS text_md5, CAST(CASE WHEN clean = '' THEN len(ls) ELSE greatest(0, len(ls) - len(string_split(clean, chr(10)))) END AS BIGINT) AS removed_lines FROM c"""
)
def str_normalize_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(table(spark, sf_dir, "parsed_chapters", "chapter_id", "text"), "chapter_id", "text", cleaning.tidy_spacing)


@query(
    f"""WITH a AS (SELECT doc_id, text AS t, {s_lines('text')} AS ls FROM documents),
b AS (SELECT doc_id, t, ls, list_filter(ls, lambda x: NOT {s_watermark('x')}) AS k1 FROM a),
c AS (SELECT doc_id, t, len(ls) - len(k1) AS r1, k1, list_filter(k1, lambda x: NOT {s_decor('x')}) AS k2 FROM b)
SELECT doc_id, CAST(length(t) AS BIGINT) AS before_chars, CAST(length(array_to_string(k1, '')) AS BIGINT) AS middle_chars, CAST(length(array_to_string(k2, '')) AS BIGINT) AS after_chars,
CAST(r1 AS BIGINT) AS watermark_lines, CAST(len(k1) - len(k2) AS BIGINT) AS decorative_lines FROM c"""
)
def str_clean_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.cleaned(table(spark, sf_dir, "documents", "doc_id", "text"), "text", ["remove_watermarks", "remove_decorative_characters"])
    s = F.col("clean_stats")
    return df.select(
        "doc_id", s[0].before_chars.alias("before_chars"), s[0].after_chars.alias("middle_chars"), s[1].after_chars.alias("after_chars"),
        s[0].removed_lines.alias("watermark_lines"), s[1].removed_lines.alias("decorative_lines"),
    )


@query(
    f"""SELECT chapter_id, CAST(length(regexp_replace(text, '[{WS}]+', '', 'g')) AS BIGINT) AS char_count,
CAST(len(list_filter(string_split_regex({s_strip('text')}, '\\n[{WS}]*\\n'), lambda x: {s_strip('x')} <> '')) AS BIGINT) AS paragraph_count FROM parsed_chapters"""
)
def prj_text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_chapters", "chapter_id", "text").select("chapter_id", text.char_count("text").alias("char_count"), text.paragraph_count("text").alias("paragraph_count"))


@query(
    f"""SELECT c.id AS chapter_id, CAST(c.char_count AS BIGINT) AS stored, CAST(length(regexp_replace(p.text, '[{WS}]+', '', 'g')) AS BIGINT) AS counted
FROM chapters c JOIN parsed_chapters p ON p.chapter_id = c.id WHERE c.char_count <> length(regexp_replace(p.text, '[{WS}]+', '', 'g'))"""
)
def jn_wrong_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are made before the join, so the join carries numbers only."""
    counted = table(spark, sf_dir, "parsed_chapters", "chapter_id", "text").select("chapter_id", text.char_count("text").alias("counted"))
    stored = table(spark, sf_dir, "chapters", "id", "char_count").select(F.col("id").alias("chapter_id"), long("char_count").alias("stored"))
    return stored.join(counted, "chapter_id").where("stored <> counted").select("chapter_id", "stored", "counted")


@query(
    """SELECT id AS segment_id, 'books/' || CAST(j.book_id AS VARCHAR) || '/translations/' || format('{:04d}', c.chapter_index) || '-' || format('{:04d}', s.segment_index) || '.txt' AS text_path,
'books/' || CAST(j.book_id AS VARCHAR) || '/audio/' || format('{:04d}', c.chapter_index) || '/jobs/' || CAST(s.job_id AS VARCHAR) || '/' || format('{:04d}', s.segment_index) || '.wav' AS sound_path
FROM (SELECT DISTINCT id, job_id, chapter_id, segment_index FROM segments) s JOIN (SELECT DISTINCT id AS jid, book_id FROM jobs) j ON j.jid = s.job_id JOIN (SELECT id AS cid, chapter_index FROM chapters) c ON c.cid = s.chapter_id"""
)
def prj_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments", "id", "job_id", "chapter_id", "segment_index", once=True)
    j = table(spark, sf_dir, "jobs", "id", "book_id", once=True).withColumnRenamed("id", "job_id")
    c = table(spark, sf_dir, "chapters", "id", "chapter_index").withColumnRenamed("id", "chapter_id")
    df = s.join(j, "job_id").join(c, "chapter_id")
    return df.select(
        F.col("id").alias("segment_id"), names.translation_path("book_id", "chapter_index", "segment_index").alias("text_path"),
        names.audio_path("book_id", "chapter_index", "segment_index", F.lit("wav"), "job_id").alias("sound_path"),
    )


def _dl_sql(x: str, fallback: str) -> str:
    one = s_strip(f"regexp_replace(regexp_replace({x}, '[\\x00-\\x1f\\x7f/\\\\:*?\"<>|]+', ' ', 'g'), '[{WS}]+', ' ', 'g')")
    return f"regexp_replace(left(CASE WHEN {one} = '' THEN {fallback} ELSE {one} END, 120), '[{WS}]+$', '')"


@query(
    f"""SELECT c.id AS chapter_id, {_dl_sql('b.title', "'book'")} || ' - ' || {_dl_sql('c.title', "'chapter-' || CAST(c.chapter_index + 1 AS VARCHAR)")} || '.wav' AS name
FROM chapters c JOIN books b ON b.id = c.book_id"""
)
def str_download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters", "id", "book_id", "chapter_index", "title")
    b = table(spark, sf_dir, "books", "id", "title").select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    return c.join(b, "book_id").select(F.col("id").alias("chapter_id"), names.download_name("book_title", "title", "chapter_index").alias("name"))


@query(
    f"""SELECT id AS chapter_id, coalesce({s_null('translated_title')}, {s_null('title')}, '第 ' || CAST(chapter_index + 1 AS VARCHAR) || ' 章') AS shown,
concat_ws(chr(10) || chr(10), {s_null('summary')}, {s_null("'  about this book '")}) AS description FROM chapters"""
)
def prj_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "chapters", "id", "chapter_index", "title", "translated_title", "summary")
    shown = names.title_or_number("translated_title", "title", index="chapter_index")
    return df.select(F.col("id").alias("chapter_id"), shown.alias("shown"), text.prompt_parts("summary", F.lit("  about this book ")).alias("description"))


@query(
    f"""WITH t AS (SELECT id, list_transform(tags, lambda x: left(regexp_replace(regexp_replace(regexp_replace({s_strip('x')}, '^[#＃]+', ''), '[#＃]+$', ''), '[{WS}]+', '', 'g'), 16)) AS ts FROM chapters),
d AS (SELECT id, list_filter(ts, lambda x, i: x <> '' AND list_position(ts, x) = i) AS ds FROM t)
SELECT id AS chapter_id, CAST(len(ds) AS BIGINT) AS n, array_to_string(ds[1:10], ',') AS tags FROM d"""
)
def arr_distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = jsons.distinct_tags(F.col("tags"))
    return table(spark, sf_dir, "chapters", "id", "tags").select(F.col("id").alias("chapter_id"), long(F.size(tags)).alias("n"), F.array_join(F.slice(tags, 1, 10), ",").alias("tags"))


@query(
    f"""SELECT id AS segment_id, concat_ws(chr(10) || chr(10), 'Render faithfully.', {s_null('source_text')}) AS prompt,
CASE WHEN length(regexp_replace({s_strip("regexp_replace(source_text, '[" + WS + "]+', ' ', 'g')")}, 'x', 'x')) > 60 THEN left({s_strip("regexp_replace(source_text, '[" + WS + "]+', ' ', 'g')")}, 57) || '...' ELSE {s_strip("regexp_replace(source_text, '[" + WS + "]+', ' ', 'g')")} END AS shown
FROM (SELECT DISTINCT id, source_text FROM segments)"""
)
def str_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "segments", "id", "source_text", once=True)
    return df.select(F.col("id").alias("segment_id"), text.prompt_parts(F.lit("Render faithfully. "), "source_text").alias("prompt"), text.shortened("source_text", 60).alias("shown"))


@query(
    """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM documents"""
)
def str_html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(text.html_escaped("text").cast("binary")).alias("escaped_md5"))


# --- JSON ----------------------------------------------------------------------------
@query(
    """SELECT id AS job_id, CASE WHEN json_type(options, '$.target_lang') = 'VARCHAR' THEN nullif(trim(options ->> '$.target_lang'), '') END AS target_lang,
CASE WHEN json_type(options, '$.parallel_segments') IN ('UBIGINT', 'BIGINT') AND CAST(options ->> '$.parallel_segments' AS BIGINT) >= 1 THEN CAST(options ->> '$.parallel_segments' AS BIGINT) END AS workers,
CASE WHEN json_type(options, '$.chapter_revision') IS NULL THEN 0 WHEN json_type(options, '$.chapter_revision') IN ('UBIGINT', 'BIGINT') AND CAST(options ->> '$.chapter_revision' AS BIGINT) >= 0 THEN CAST(options ->> '$.chapter_revision' AS BIGINT) END AS revision,
coalesce(CASE json_type(options, '$.merge') WHEN 'BOOLEAN' THEN (options ->> '$.merge') = 'true' WHEN 'NULL' THEN false END, true) AS merge
FROM (SELECT DISTINCT id, options FROM jobs)"""
)
def jsn_strict_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "jobs", "id", "options", once=True).withColumn("v", jsons.parsed("options"))
    v = F.col("v")
    return df.select(
        F.col("id").alias("job_id"), jsons.strict_text(v, "target_lang").alias("target_lang"), jsons.strict_int(v, "parallel_segments", 1).alias("workers"),
        jsons.revision(v, "chapter_revision").alias("revision"), jsons.truthy(v, "merge").alias("merge"),
    )


@query(
    """SELECT id AS job_id, CASE WHEN w IS NULL THEN 2 WHEN w >= 1 THEN least(w, 2) END AS workers,
CAST(least(30.0, pow(2.0, completed_units % 7)) AS DOUBLE) AS delay FROM (SELECT DISTINCT id, completed_units, CAST(options ->> '$.parallel_segments' AS BIGINT) AS w FROM jobs)"""
)
def mth_workers_and_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "jobs", "id", "completed_units", "options", once=True)
    w = jsons.strict_int(jsons.parsed("options"), "parallel_segments")
    delay = jsons.retry_delay(F.col("completed_units") % 7, F.lit(None).cast("string"))
    return df.select(F.col("id").alias("job_id"), long(jsons.bounded_parallel(w, F.lit(2))).alias("workers"), delay.alias("delay"))


# --- tables from texts -----------------------------------------------------------------
_SPLIT_SQL = """WITH RECURSIVE t AS (SELECT DISTINCT {key} AS k, {norm} AS rest FROM {src}),
r AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS piece, rest FROM t
 UNION ALL SELECT k, i + 1, left(rest, n), substr(rest, CAST(n + 1 AS BIGINT)) FROM (
  SELECT k, i, rest, CASE WHEN length(rest) <= {n} THEN length(rest)
   WHEN length(regexp_extract(left(rest, {n} + 1), '(?s)^.*\\n\\n')) BETWEEN 1 AND {n} THEN length(regexp_extract(left(rest, {n} + 1), '(?s)^.*\\n\\n'))
   WHEN length(regexp_extract(left(rest, {n}), '(?s)^.*\\n')) > 0 THEN length(regexp_extract(left(rest, {n}), '(?s)^.*\\n')) ELSE {n} END AS n FROM r WHERE rest <> ''))
SELECT k AS {key}, CAST(i - 1 AS BIGINT) AS segment_index, md5(piece) AS piece_md5, CAST(length(piece) AS BIGINT) AS chars FROM r WHERE i > 0"""


@query(_SPLIT_SQL.format(key="chapter_id", norm=s_strip(s_unix("text")), src="parsed_chapters", n=900))
def tvf_bounded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = segments.segment_rows(table(spark, sf_dir, "parsed_chapters", "chapter_id", "text"), "chapter_id", "text", 900)
    return df.select("chapter_id", "segment_index", F.md5(F.col("segment_text").cast("binary")).alias("piece_md5"), long(F.length("segment_text")).alias("chars"))


@query(
    f"""WITH t AS (SELECT book_id, {s_strip(s_unix('full_text'))} AS t FROM parsed_books),
p AS (SELECT book_id, t, unnest(range(0, CAST(ceil(length(t) / 2000.0) AS BIGINT))) AS i FROM t)
SELECT book_id, '第 ' || CAST(i + 1 AS VARCHAR) || ' 段' AS title, md5(substr(t, CAST(i * 2000 + 1 AS BIGINT), 2000)) AS text_md5 FROM p"""
)
def tvf_split_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.strip(text.unix_lines("full_text"))
    df = table(spark, sf_dir, "parsed_books", "book_id", "full_text").select("book_id", F.explode_outer(chapters.by_size(t, 2000)).alias("c")).where("c is not null")
    return df.select("book_id", "c.title", F.md5(F.col("c.text").cast("binary")).alias("text_md5"))


# The forms of headings in RE2's spelling.
_NUM, _ROM = r"[零〇一二三四五六七八九十百千万两\p{Nd}]+", "[IVXLCDM]+"
_HEAD = rf"(?i)^(?:第{_NUM}[{WS}]*[章节回卷部篇].*|卷[{WS}]*{_NUM}.*|(?:Chapter|Section|Part|Book)[{WS}]+(?:\p{{Nd}}+|{_ROM})(?:[^\p{{L}}\p{{N}}_].*)?|(?:\p{{Nd}}+|{_ROM})[.)、][{WS}]+[^{WS}].*|(?:序|序章|序言|前言|楔子|尾声|后记))$"


@query(
    f"""WITH t AS (SELECT doc_id, {s_strip(s_unix('text'))} AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM t WHERE t <> ''),
h AS (SELECT doc_id, line, n, (length({s_strip('line')}) BETWEEN 1 AND 80 AND regexp_matches({s_strip('line')}, '{_HEAD}')) AS head FROM l),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS heads FROM h),
g AS (SELECT doc_id, sec, heads, coalesce(max({s_strip('line')}) FILTER (WHERE head), '前言') AS title, {s_strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head), '')")} AS body FROM s GROUP BY doc_id, sec, heads)
SELECT doc_id, title, md5(body) AS text_md5, CAST(length(body) AS BIGINT) AS chars FROM g WHERE heads >= 2 AND (sec > 0 OR body <> '')
UNION ALL SELECT doc_id, '第 ' || CAST(i + 1 AS VARCHAR) || ' 段', md5(substr(t, CAST(i * 6000 + 1 AS BIGINT), 6000)), CAST(length(substr(t, CAST(i * 6000 + 1 AS BIGINT), 6000)) AS BIGINT)
FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 6000.0) AS BIGINT))) AS i FROM t WHERE doc_id NOT IN (SELECT doc_id FROM g WHERE heads >= 2))"""
)
def tvf_split_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode_outer(chapters.chapters_of(F.col("text"))).alias("c")).where("c is not null")
    return df.select("doc_id", "c.title", F.md5(F.col("c.text").cast("binary")).alias("text_md5"), long(F.length("c.text")).alias("chars"))


# --- joins, aggregates, windows -----------------------------------------------------------
_JOBS = "(SELECT DISTINCT id, book_id, chapter_id, kind, status, total_units, completed_units, failed_units, options FROM jobs)"
_SEGS = "(SELECT DISTINCT id, job_id, chapter_id, segment_index, status, output_path, result_text FROM segments)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs", "id", "book_id", "chapter_id", "kind", "status", "total_units", "completed_units", "failed_units", "options", once=True)


def _segments(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "segments", "id", "job_id", "chapter_id", "segment_index", "status", *more, once=True)


@query(
    f"""SELECT j.id AS job_id, count(s.id) AS segment_count, count(*) FILTER (WHERE s.status = 'completed') AS completed_count, count(*) FILTER (WHERE s.status = 'failed') AS failed_count,
count(*) FILTER (WHERE s.status = 'running') AS running_count, count(*) FILTER (WHERE s.status = 'pending') AS pending_count,
CAST(CASE WHEN count(s.id) > 0 THEN count(s.id) ELSE max(j.total_units) END AS BIGINT) AS total_units FROM {_JOBS} j LEFT JOIN {_SEGS} s ON s.job_id = j.id GROUP BY j.id"""
)
def agg_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relational.with_counts(_jobs(spark, sf_dir).select("id", "total_units"), _segments(spark, sf_dir))
    total = F.when(F.col("segment_count") > 0, F.col("segment_count")).otherwise(long("total_units"))
    return df.select(F.col("id").alias("job_id"), "segment_count", "completed_count", "failed_count", "running_count", "pending_count", total.alias("total_units"))


@query(
    f"""SELECT j.id AS job_id FROM {_JOBS} j JOIN (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS c FROM {_SEGS} GROUP BY job_id) s ON s.job_id = j.id
WHERE j.total_units <> s.n OR j.completed_units <> s.c"""
)
def jn_unit_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relational.with_counts(_jobs(spark, sf_dir), _segments(spark, sf_dir)).where("segment_count > 0")
    return df.where("total_units <> segment_count or completed_units <> completed_count").select(F.col("id").alias("job_id"))


@query(f"SELECT id AS job_id FROM {_JOBS} j WHERE NOT EXISTS (SELECT 1 FROM jobs k WHERE k.chapter_id = j.chapter_id AND k.kind = j.kind AND k.id > j.id)")
def jn_no_newer_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.without_newer(_jobs(spark, sf_dir), ["chapter_id", "kind"]).select(F.col("id").alias("job_id"))


@query(f"SELECT chapter_id, kind, id AS job_id, status FROM {_JOBS} WHERE chapter_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chapter_id, kind ORDER BY id DESC) = 1")
def win_latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relational.latest(_jobs(spark, sf_dir).where("chapter_id is not null"), ["chapter_id", "kind"], "id")
    return df.select("chapter_id", "kind", F.col("id").alias("job_id"), "status")


@query(
    f"""WITH l AS (SELECT chapter_id, max(id) AS job_id FROM jobs WHERE kind = 'tts' AND chapter_id IS NOT NULL GROUP BY chapter_id)
SELECT l.chapter_id, s.id AS segment_id, CAST(s.segment_index AS BIGINT) AS segment_index, s.output_path FROM l JOIN {_SEGS} s ON s.job_id = l.job_id WHERE s.output_path IS NOT NULL"""
)
def jn_latest_job_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = relational.latest(_jobs(spark, sf_dir).where("kind = 'tts' and chapter_id is not null").select("id", "chapter_id"), ["chapter_id"], "id")
    s = _segments(spark, sf_dir, "output_path").where("output_path is not null").drop("chapter_id")
    return newest.select("chapter_id", F.col("id").alias("job_id")).join(s, "job_id").select("chapter_id", F.col("id").alias("segment_id"), long("segment_index").alias("segment_index"), "output_path")


@query(
    f"""SELECT b.id AS book_id, count(DISTINCT c.id) AS chapters, count(s.output_path) AS sounds, count(DISTINCT CASE WHEN c.audio_path IS NOT NULL THEN c.id END) AS merged
FROM books b LEFT JOIN chapters c ON c.book_id = b.id LEFT JOIN {_SEGS} s ON s.chapter_id = c.id GROUP BY b.id"""
)
def jn_book_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds are counted by chapter before the joins, against the hot chapter."""
    sounds = _segments(spark, sf_dir, "output_path").groupBy("chapter_id").agg(F.count("output_path").alias("n"))
    c = table(spark, sf_dir, "chapters", "id", "book_id", "audio_path").withColumnRenamed("id", "chapter_id").join(sounds, "chapter_id", "left")
    per = c.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("n").alias("sounds"), F.count("audio_path").alias("merged"))
    b = table(spark, sf_dir, "books", "id").withColumnRenamed("id", "book_id").join(per, "book_id", "left")
    return b.select("book_id", *(F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in ("chapters", "sounds", "merged")))


@query(f"SELECT job_id, md5(string_agg(coalesce(result_text, ''), chr(10) || chr(10) ORDER BY segment_index, id)) AS text_md5, count(*) AS pieces FROM {_SEGS} GROUP BY job_id")
def agg_ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir, "result_text").withColumn("o", F.struct("segment_index", "id"))
    out = segments.reassembled(s, ["job_id"], "o", "result_text")
    return out.join(s.groupBy("job_id").agg(F.count("*").alias("pieces")), "job_id").select("job_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "pieces")


@query(f"SELECT job_id FROM {_SEGS} GROUP BY job_id HAVING bool_and(status = 'completed' AND result_text IS NOT NULL)")
def agg_all_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.all_done(_segments(spark, sf_dir, "result_text"), "job_id", "result_text")


@query(f"SELECT job_id, id AS segment_id FROM {_SEGS} WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY segment_index) <= 2")
def win_queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.next_in_queue(_segments(spark, sf_dir), workers=2).select("job_id", F.col("id").alias("segment_id"))


@query("SELECT title, min(id) AS book_id, count(*) AS copies FROM books GROUP BY title")
def win_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "books", "id", "title")
    first = relational.first_wins(b, ["title"], "id").select("title", F.col("id").alias("book_id"))
    return first.join(b.groupBy("title").agg(F.count("*").alias("copies")), "title")


@query(f"SELECT id AS job_id, kind FROM {_JOBS} WHERE kind <> 'split' ORDER BY id DESC LIMIT 4")
def srt_job_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the report: the four newest jobs."""
    return _jobs(spark, sf_dir).where("kind <> 'split'").orderBy(F.desc("id")).limit(4).select(F.col("id").alias("job_id"), "kind")


@query("SELECT id AS book_id, title FROM books ORDER BY id DESC LIMIT 1")
def srt_current_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books", "id", "title").orderBy(F.desc("id")).limit(1).select(F.col("id").alias("book_id"), "title")


# --- sets and changes of tables ------------------------------------------------------------
@query(
    f"""WITH p AS (SELECT id AS chapter_id, 0 AS a, CAST(-1 AS BIGINT) AS b, audio_path AS p FROM chapters WHERE audio_path IS NOT NULL
UNION ALL SELECT chapter_id, 1, id, output_path FROM {_SEGS} WHERE output_path IS NOT NULL),
d AS (SELECT chapter_id, p, min((a, b)) AS o FROM p WHERE p <> '' GROUP BY chapter_id, p)
SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY o, p) AS place, p AS path FROM d"""
)
def set_ordered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged sound first, then the parts, the first of equal paths, as rows with
    their place: a chapter that holds a third of all rows needs no single task."""
    s = _segments(spark, sf_dir, "output_path").select("chapter_id", F.lit(1).alias("a"), F.col("id").alias("b"), F.col("output_path").alias("p"))
    c = table(spark, sf_dir, "chapters", "id", "audio_path").select(F.col("id").alias("chapter_id"), F.lit(0).alias("a"), F.lit(-1).cast("bigint").alias("b"), F.col("audio_path").alias("p"))
    d = s.unionByName(c).where("p is not null and p <> ''").groupBy("chapter_id", "p").agg(F.min(F.struct("a", "b")).alias("o"))
    return relational.placed(d, ["chapter_id"], ["o", "p"], "place").select("chapter_id", "place", F.col("p").alias("path"))


@query("SELECT id AS chapter_id, book_id, title FROM chapters WHERE book_id NOT IN (SELECT book_id FROM parsed_books WHERE source_format = 'txt') UNION ALL SELECT book_id, book_id, title FROM parsed_books WHERE source_format = 'txt'")
def set_replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "chapters", "id", "book_id", "title").withColumnRenamed("id", "chapter_id")
    new = table(spark, sf_dir, "parsed_books", "book_id", "title", "source_format").where("source_format = 'txt'").select(F.col("book_id").alias("chapter_id"), "book_id", "title")
    return relational.replaced(old, new, "book_id")


@query(
    f"""WITH g AS (SELECT id FROM books WHERE source_format = 'txt'), c AS (SELECT id FROM chapters WHERE book_id NOT IN (SELECT id FROM g)),
j AS (SELECT DISTINCT id FROM jobs WHERE book_id NOT IN (SELECT id FROM g)), s AS (SELECT DISTINCT id, job_id, chapter_id FROM segments)
SELECT 'books' AS tab, count(*) AS n FROM books WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'chapters', count(*) FROM c UNION ALL SELECT 'jobs', count(*) FROM j
UNION ALL SELECT 'segments', count(*) FROM s WHERE job_id IN (SELECT id FROM j)"""
)
def dml_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "books", "id", "source_format")
    tables = {"books": books, "chapters": table(spark, sf_dir, "chapters", "id", "book_id"), "jobs": _jobs(spark, sf_dir).select("id", "book_id"), "segments": _segments(spark, sf_dir).select("id", "job_id")}
    links = [("books", "id", "chapters", "book_id"), ("books", "id", "jobs", "book_id"), ("jobs", "id", "segments", "job_id")]
    left = relational.cascade_deleted(tables, books.where("source_format = 'txt'").select("id"), links)
    out = None
    for k, df in left.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("tab"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    """SELECT c.id AS chapter_id, CASE WHEN p.chapter_id IS NULL THEN c.title ELSE upper(p.title) END AS title, CASE WHEN p.chapter_id IS NULL THEN c.translation_path END AS translation_path,
CAST(CASE WHEN p.chapter_id IS NULL THEN c.content_revision ELSE c.content_revision + 1 END AS INTEGER) AS content_revision
FROM chapters c LEFT JOIN (SELECT chapter_id, title FROM parsed_chapters WHERE length(text) < 500) p ON p.chapter_id = c.id"""
)
def dml_upsert_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited chapters get a new title and revision and lose what was made from
    the old text."""
    c = table(spark, sf_dir, "chapters", "id", "title", "translation_path", "content_revision").withColumnRenamed("id", "chapter_id")
    edited = table(spark, sf_dir, "parsed_chapters", "chapter_id", "title", "text").where(F.length("text") < 500).select("chapter_id", F.upper("title").alias("title"))
    changes = edited.join(c.select("chapter_id", (F.col("content_revision") + 1).alias("content_revision")), "chapter_id").withColumn("translation_path", F.lit(None).cast("string"))
    return relational.upserted(c, changes, "chapter_id")


@query(
    f"""SELECT j.id AS job_id FROM {_JOBS} j JOIN chapters c ON c.id = j.chapter_id WHERE c.content_revision =
CASE WHEN json_type(options, '$.chapter_revision') IS NULL THEN 0 WHEN json_type(options, '$.chapter_revision') IN ('UBIGINT', 'BIGINT') AND CAST(options ->> '$.chapter_revision' AS BIGINT) >= 0 THEN CAST(options ->> '$.chapter_revision' AS BIGINT) END
AND NOT EXISTS (SELECT 1 FROM jobs k WHERE k.chapter_id = j.chapter_id AND k.kind = j.kind AND k.id > j.id)"""
)
def stm_fresh_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose results may still be used: of the chapter's present revision
    and with no newer job of the kind."""
    jobs = relational.without_newer(_jobs(spark, sf_dir), ["chapter_id", "kind"])
    fresh = relational.stale_rejected(jobs, table(spark, sf_dir, "chapters", "id", "content_revision"), jsons.revision(jsons.parsed("options"), "chapter_revision"))
    return fresh.select(F.col("id").alias("job_id"))


# --- sound ------------------------------------------------------------------------------
def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    s = F.transform("embedding", lambda x: F.floor(x.cast("double") * 32768).cast("smallint"))
    return df.select("vec_id", s.alias("samples"), F.lit(1).alias("channels"), F.lit(1000).alias("sample_rate"), F.lit(2).alias("sample_width"))


@query(
    """WITH s AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
b AS (SELECT vec_id, CAST(i // 7 AS BIGINT) AS bucket, max(abs(CAST(floor(CAST(x AS DOUBLE) * 32768) AS INTEGER))) AS top FROM s GROUP BY 1, 2)
SELECT vec_id, bucket, round_even(least(1.0, top / 32768.0), 4) AS peak FROM b"""
)
def aud_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _samples(spark, sf_dir).select("vec_id", F.posexplode(audio.peaks(F.col("samples"), F.col("channels"), 10)).alias("bucket", "peak"))
    return df.select("vec_id", long("bucket").alias("bucket"), "peak")


@query(
    """WITH s AS (SELECT vec_id, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 32768) AS INTEGER) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
r AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, abs(x) <= 3000 ORDER BY i) AS isl FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, abs(x) <= 3000, isl ORDER BY i) AS place FROM r)
SELECT vec_id, count(*) AS frames, CAST(sum(x) AS BIGINT) AS total FROM k WHERE abs(x) > 3000 OR place <= 2 GROUP BY vec_id"""
)
def aud_silence_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audio.collapse_silence(_samples(spark, sf_dir), ms=2, threshold=3000)
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.select("vec_id", long(F.size("samples")).alias("frames"), total.alias("total"))


@query(
    """WITH s AS (SELECT vec_id // 8 AS album, vec_id, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 32768) AS INTEGER) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT album, count(DISTINCT vec_id) AS parts, count(*) AS frames, md5(string_agg(CAST(x AS VARCHAR), ',' ORDER BY vec_id, i)) AS samples_md5 FROM s GROUP BY album"""
)
def aud_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums of eight parts each: a merged sound is one value, so what goes
    into it is bounded by the album."""
    album = _samples(spark, sf_dir).withColumn("album", F.expr("vec_id div 8"))
    df = audio.merged(album, ["album"], "vec_id")
    joined = F.array_join(F.transform("samples", lambda x: x.cast("string")), ",")
    return df.select("album", "parts", long(F.size("samples")).alias("frames"), F.md5(joined.cast("binary")).alias("samples_md5"))


# --- more projections, filters and lookups --------------------------------------------
@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE octet_length(encode(text)) <= 4096")
def src_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", "doc_id", "text")
    size = long(F.octet_length("text"))
    return df.where(size <= 4096).select("doc_id", size.alias("bytes"))


@query("SELECT c.id AS chapter_id, CAST(c.chapter_index AS BIGINT) AS chapter_index, c.title FROM chapters c WHERE c.book_id = (SELECT max(id) FROM books)")
def src_chapters_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of the newest book; the lookup is a semi join on one row."""
    book = table(spark, sf_dir, "books", "id").agg(F.max("id").alias("book_id"))
    c = table(spark, sf_dir, "chapters", "id", "book_id", "chapter_index", "title").join(book, "book_id", "left_semi")
    return c.select(F.col("id").alias("chapter_id"), long("chapter_index").alias("chapter_index"), "title")


@query("SELECT c.id AS chapter_id, t.book_id IS NULL AS missing, CAST(length(t.full_text) AS BIGINT) AS chars FROM chapters c LEFT JOIN parsed_books t ON t.book_id = c.book_id")
def src_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts looked up by key; what isn't there is told, not dropped."""
    texts = table(spark, sf_dir, "parsed_books", "book_id", "full_text").select("book_id", long(F.length("full_text")).alias("chars"), F.lit(1).alias("there"))
    c = table(spark, sf_dir, "chapters", "id", "book_id").withColumnRenamed("id", "chapter_id")
    return c.join(texts, "book_id", "left").select("chapter_id", F.col("there").isNull().alias("missing"), "chars")


@query(
    """SELECT id AS job_id, CAST(CASE WHEN total_units <= 0 OR completed_units <= 0 THEN 0 ELSE least(100, greatest(0, floor(100.0 * completed_units / total_units + 0.5))) END AS BIGINT) AS percent,
coalesce(map {'pending': '等待中', 'running': '运行中', 'paused': '已暂停', 'completed': '已完成', 'completed_with_errors': '部分完成', 'failed': '失败', 'stopped': '已停止'}[status], nullif(status, ''), '未知') AS label FROM (SELECT DISTINCT id, total_units, completed_units, status FROM jobs)"""
)
def prj_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "jobs", "id", "total_units", "completed_units", "status", once=True)
    percent = display.progress_percent(F.col("completed_units"), F.col("total_units"))
    return df.select(F.col("id").alias("job_id"), percent.alias("percent"), display.status_label(F.col("status")).alias("label"))


@query("SELECT id AS chapter_id, format('{:,}', CAST(greatest(0, floor(char_count / 2.0 + 0.5)) AS BIGINT)) AS words FROM chapters")
def prj_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters", "id", "char_count").select(F.col("id").alias("chapter_id"), display.word_count_label(F.col("char_count")).alias("words"))


@query(
    """SELECT id AS chapter_id, CASE WHEN translation_path IS NOT NULL THEN 'translation' ELSE 'chapter' END AS source, CASE WHEN id % 2 = 0 AND translation_path IS NOT NULL THEN 'translation' ELSE 'chapter' END AS asked,
coalesce(nullif(translation_path, ''), text_path) AS path FROM chapters"""
)
def prj_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "chapters", "id", "translation_path", "text_path")
    return df.select(
        F.col("id").alias("chapter_id"), names.speech_source(F.lit("translation"), "translation_path").alias("source"),
        names.speech_source(F.when(F.col("id") % 2 == 0, "translation").otherwise("chapter"), "translation_path").alias("asked"), names.text_source("translation_path", "text_path").alias("path"),
    )


@query(f"SELECT doc_id, CAST(len(list_filter({s_lines('text')}, lambda x: {s_noise('x')})) AS BIGINT) AS noisy FROM documents")
def flt_short_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.size(F.filter(text.lines_with_ends("text"), lambda x: cleaning.is_short_noise(x)))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", long(noisy).alias("noisy"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, {s_strip('x')} AS heading FROM l WHERE length({s_strip('x')}) BETWEEN 1 AND 80 AND regexp_matches({s_strip('x')}, '{_HEAD}')"""
)
def flt_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.transform(F.split("text", "\n"), text.strip), chapters.is_heading)
    df = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode_outer(found).alias("heading"))
    return df.where("heading is not null")


@query("SELECT c.chapter_id, unnest(range(0, len(c.ts))) AS tag_index, unnest(c.ts) AS tag FROM (SELECT id AS chapter_id, tags AS ts FROM chapters) c")
def win_enumerated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "chapters", "id", "tags")
    return df.select(F.col("id").alias("chapter_id"), F.posexplode("tags").alias("i", "tag")).select("chapter_id", long("i").alias("tag_index"), "tag")


@query(
    f"""WITH p AS (SELECT c.book_id, c.chapter_index, 0 AS a, CAST(-1 AS BIGINT) AS o, c.audio_path AS p FROM chapters c WHERE c.audio_path IS NOT NULL
UNION ALL SELECT c.book_id, c.chapter_index, 1, s.id, s.output_path FROM chapters c JOIN {_SEGS} s ON s.chapter_id = c.id WHERE s.output_path IS NOT NULL)
SELECT book_id, count(DISTINCT p) AS n, arg_min(p, (chapter_index, a, o)) AS first_path FROM p GROUP BY book_id"""
)
def jn_book_audio_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters", "id", "book_id", "chapter_index", "audio_path").withColumnRenamed("id", "chapter_id")
    s = _segments(spark, sf_dir, "output_path").where("output_path is not null").select("chapter_id", F.lit(1).alias("a"), F.col("id").alias("o"), F.col("output_path").alias("p"))
    parts = c.select("chapter_id", "book_id", "chapter_index").join(s, "chapter_id").drop("chapter_id")
    whole = c.where("audio_path is not null").select("book_id", "chapter_index", F.lit(0).alias("a"), F.lit(-1).cast("bigint").alias("o"), F.col("audio_path").alias("p"))
    return parts.unionByName(whole).groupBy("book_id").agg(F.count_distinct("p").alias("n"), F.min_by("p", F.struct("chapter_index", "a", "o")).alias("first_path"))


@query(
    """SELECT j.id AS job_id, p.priority, p.priority IS NULL AS unknown FROM (SELECT DISTINCT id, options ->> '$.provider' AS provider FROM jobs) j
LEFT JOIN (VALUES ('alpha', 1), ('beta', 2)) p(provider, priority) ON p.provider = j.provider"""
)
def jn_option_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in a literal map of two entries; a missing key is told."""
    df = table(spark, sf_dir, "jobs", "id", "options", once=True)
    rank = F.create_map(F.lit("alpha"), F.lit(1), F.lit("beta"), F.lit(2))[jsons.strict_text(jsons.parsed("options"), "provider")]
    return df.select(F.col("id").alias("job_id"), rank.alias("priority"), rank.isNull().alias("unknown"))


@query(
    """SELECT book_id, count(*) AS chapters, md5(string_agg(title, chr(10) ORDER BY chapter_index)) AS titles_md5, bool_or(length(text) > 6000) AS any_long, bool_and(length(text) > 0) AS all_filled FROM parsed_chapters GROUP BY book_id"""
)
def agg_book_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are reduced to their lengths before the shuffle."""
    df = table(spark, sf_dir, "parsed_chapters", "book_id", "chapter_index", "title", "text").select("book_id", "chapter_index", "title", F.length("text").alias("n"))
    titles = segments.reassembled(df, ["book_id"], "chapter_index", "title", "\n", "titles")
    rest = df.groupBy("book_id").agg(F.count("*").alias("chapters"), F.bool_or(F.col("n") > 6000).alias("any_long"), F.bool_and(F.col("n") > 0).alias("all_filled"))
    return rest.join(titles, "book_id").select("book_id", "chapters", F.md5(F.col("titles").cast("binary")).alias("titles_md5"), "any_long", "all_filled")


@query("SELECT id AS segment_id, left(error_message, 1000) AS error, regexp_extract(error_message, 'HTTP ([0-9]{3})', 1) AS code FROM (SELECT DISTINCT id, error_message FROM segments) WHERE error_message IS NOT NULL")
def str_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "segments", "id", "error_message", once=True).where("error_message is not null")
    return df.select(F.col("id").alias("segment_id"), F.left("error_message", F.lit(1000)).alias("error"), F.regexp_extract("error_message", "HTTP ([0-9]{3})", 1).alias("code"))


@query(
    """SELECT id AS book_id, CASE WHEN last IN ('', '.', '..') THEN NULL ELSE last END AS upload_name, replace(source_path, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) AS listed
FROM (SELECT id, source_path, list_last(string_split(replace('up' || chr(92) || 'dir/' || original_filename, chr(92), '/'), '/')) AS last FROM books)"""
)
def str_upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "books", "id", "original_filename", "source_path")
    return df.select(F.col("id").alias("book_id"), names.upload_name(F.concat(F.lit("up\\dir/"), F.col("original_filename"))).alias("upload_name"), names.concat_list_escaped("source_path").alias("listed"))


@query("SELECT id AS chapter_id, to_json({'id': id, 'title': title, 'index': chapter_index}) AS doc FROM chapters")
def snk_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "chapters", "id", "title", "chapter_index")
    return df.select(F.col("id").alias("chapter_id"), F.to_json(F.struct("id", "title", F.col("chapter_index").alias("index"))).alias("doc"))


@query(
    """SELECT 'job-' || CAST(job_id AS VARCHAR) AS archive, id AS segment_id, CASE WHEN output_path = '' OR contains(output_path, chr(92)) OR output_path LIKE '/%' OR regexp_matches(output_path, '(^|/)[.][.](/|$)') OR regexp_matches(output_path, '^[./]*$') THEN NULL ELSE output_path END AS archive_name
FROM (SELECT DISTINCT id, job_id, output_path FROM segments) WHERE output_path IS NOT NULL"""
)
def snk_archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir, "output_path").where("output_path is not null")
    entries = s.select(F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("archive"), F.col("segment_index").alias("position"), F.col("output_path").alias("path"), F.col("id").alias("segment_id"))
    return sinks.archive_manifest(entries).select("archive", "segment_id", "archive_name")


@query("SELECT row_number() OVER (ORDER BY book_id, chapter_index) AS new_id, book_id, CAST(chapter_index AS BIGINT) AS chapter_index FROM parsed_chapters")
def snk_assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids in order without a window over the whole table."""
    df = table(spark, sf_dir, "parsed_chapters", "book_id", "chapter_index").select("book_id", long("chapter_index").alias("chapter_index"))
    return relational.numbered(df, ["book_id", "chapter_index"], "new_id").select("new_id", "book_id", "chapter_index")


@query(
    f"""WITH t AS (SELECT id, title, list_transform(tags, lambda x: left(regexp_replace(regexp_replace(regexp_replace({s_strip('x')}, '^[#＃]+', ''), '[#＃]+$', ''), '[{WS}]+', '', 'g'), 16)) AS ts FROM chapters),
d AS (SELECT id, title, array_to_string(list_filter(ts, lambda x, i: x <> '' AND list_position(ts, x) = i)[1:10], ',') AS tags FROM t)
SELECT id AS chapter_id, CASE id % 6 WHEN 3 THEN NULL WHEN 5 THEN '' ELSE tags END AS tags, CASE WHEN id % 6 IN (0, 4) THEN nullif({s_strip('title')}, '') END AS title FROM d"""
)
def jsn_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of six shapes: fenced JSON, a bare array, a list of words, NULL,
    JSON within prose, JSON of another kind."""
    df = table(spark, sf_dir, "chapters", "id", "title", "tags")
    doc = F.to_json(F.struct("tags", "title"))
    k = F.col("id") % 6
    answer = (
        F.when(k == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).when(k == 1, F.to_json("tags")).when(k == 2, F.array_join("tags", "，"))
        .when(k == 4, F.concat(F.lit("Here it is: "), doc, F.lit(" Enjoy."))).when(k == 5, F.lit("17"))
    )
    return df.withColumn("a", answer).select(F.col("id").alias("chapter_id"), F.array_join(jsons.answer_tags("a"), ",").alias("tags"), jsons.answer_field("a", "title").alias("title"))


# --- external functions, streams, pipelines --------------------------------------------------
@query("SELECT DISTINCT id AS segment_id, 'completed' AS status, '译文：' || source_text AS result FROM segments")
def udf_fake_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "segments", "id", "source_text", once=True).withColumnRenamed("id", "segment_id")
    return apply_provider(df, "segment_id", "source_text", "fake").select("segment_id", "status", "result")


@query(
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id AS job_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS completed,
count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1, 2"""
)
def stm_windowed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, run until all of it is processed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    ev = raw.select("event_id", "ts", F.col("user_id").alias("job_id"), status.alias("status"))
    at = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    done = progress.run_once(progress.windowed_progress(ev, "1 day", late=None), f"{at}/out", f"{at}/state")
    return done.select("window_start", "job_id", "events", "completed", "failed")
