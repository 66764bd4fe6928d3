"""More queries of the core operators over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.file_queries import _candidates, _md5
from lectern.functions import display, jsons, names, prompts, text
from lectern.functions.providers import apply_provider, linear, silent_speech
from lectern.operators import relational, segments
from lectern.plans import pipeline
from lectern.queries import _HEAD, _JOBS, _SEGS, _SPLIT_SQL, _jobs, _segments, _tidy_sql, long, query, s_decor, s_lines, s_noise, s_strip, s_unix, s_watermark, table
from lectern.sources import files

Q = "''"


# --- prompts and answers -------------------------------------------------------------
@query(
    f"""SELECT c.id AS chapter_id, md5('{prompts.TITLE_TASK}原章节名：' || c.title || '

原文节选：
' || left(p.text, 1800) || '

译文节选：
' || left(p.text, 2600)) AS title_md5, md5('{prompts.TAGS_TASK}' || CASE WHEN c.id % 2 = 0 THEN '
发布背景：book ' || CAST(c.book_id AS VARCHAR) ELSE '' END || '

原章节名：' || c.title || '
中文章节名：' || coalesce(c.translated_title, '') || '
章节简介：' || coalesce(c.summary, '') || '

正文节选：
' || left(p.text, 2600)) AS tags_md5, concat_ws(chr(10), CASE WHEN c.id % 2 = 0 THEN 'book ' || CAST(c.book_id AS VARCHAR) END, 'Narration style: ' || nullif({s_strip('c.title')}, ''), 'Work background: ' || nullif({s_strip('c.summary')}, '')) AS speech
FROM chapters c JOIN parsed_chapters p ON p.chapter_id = c.id"""
)
def str_chapter_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are cut to their excerpts before the join."""
    excerpt = max(prompts.SOURCE_EXCERPT, prompts.RESULT_EXCERPT, prompts.TAGS_EXCERPT)
    p = table(spark, sf_dir, "parsed_chapters", "chapter_id", "text").select("chapter_id", F.left("text", F.lit(excerpt)).alias("text"))
    c = table(spark, sf_dir, "chapters", "id", "book_id", "title", "translated_title", "summary").withColumnRenamed("id", "chapter_id")
    about = F.when(F.col("chapter_id") % 2 == 0, F.format_string("  book %d ", "book_id")).otherwise("  ")
    return c.join(p, "chapter_id").select(
        "chapter_id", _md5(prompts.title_prompt("title", "text", "text")).alias("title_md5"), _md5(prompts.tags_prompt("title", "translated_title", "summary", "text", about)).alias("tags_md5"),
        prompts.speech_context(about, "title", F.lit(" "), "summary").alias("speech"),
    )


@query(
    f"""SELECT id AS chapter_id, CASE id % 4 WHEN 0 THEN 'Say ' || title || '!' WHEN 2 THEN '{{x}} ' || title END AS filled, concat_ws(chr(10) || chr(10), nullif({s_strip('summary')}, ''), '{{source_text}}') AS template FROM chapters"""
)
def str_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates filled in; one with stray braces is invalid."""
    k = F.col("id") % 4
    t = F.when(k == 0, "Say {source_text}!").when(k == 1, "Say {other}").when(k == 2, "{{x}} {source_text}").otherwise("}{")
    df = table(spark, sf_dir, "chapters", "id", "title", "summary")
    return df.select(F.col("id").alias("chapter_id"), text.filled_template(t, "title").alias("filled"), prompts.translation_template(F.lit(" "), "summary").alias("template"))


@query(
    f"""SELECT id AS segment_id, CASE id % 3 WHEN 0 THEN coalesce(nullif({s_strip('error_message')}, ''), 'HTTP 503: Service Unavailable') WHEN 1 THEN 'HTTP 503: ' || error_message ELSE 'HTTP 503: Service Unavailable' END AS shown
FROM (SELECT DISTINCT id, error_message FROM segments) WHERE error_message IS NOT NULL"""
)
def str_error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls: the error's own text, a body that is no JSON, one without text."""
    df = table(spark, sf_dir, "segments", "id", "error_message", once=True).where("error_message is not null")
    k, e = F.col("id") % 3, F.col("error_message")
    body = F.when(k == 0, F.to_json(F.struct(F.struct(e.alias("message")).alias("error")))).when(k == 1, e).otherwise('{"error": 5}')
    return df.select(F.col("id").alias("segment_id"), jsons.error_text(F.lit(503), F.lit("Service Unavailable"), body).alias("shown"))


_SILENCE = silent_speech([""])[0]


@query(
    f"""SELECT id AS chapter_id, CASE WHEN id % 6 <> 5 THEN nullif({s_strip('title')}, '') END AS content, CASE id % 6 WHEN 0 THEN {len(_SILENCE)} END AS sound_bytes,
CASE id % 6 WHEN 1 THEN 'missing audio' WHEN 2 THEN 'invalid base64' WHEN 3 THEN 'not a readable WAV file' WHEN 4 THEN 'not a WAV file' WHEN 5 THEN 'invalid response' END AS error FROM chapters"""
)
def jsn_provider_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a chat and of a speech model, whole and damaged."""
    df = table(spark, sf_dir, "chapters", "id", "title")
    k = F.col("id") % 6
    data = F.when(k == 0, F.base64(F.lit(_SILENCE))).when(k == 2, "!!").when(k == 3, F.base64(F.lit(b"RIFF\x04\x00\x00\x00WAVE"))).when(k == 4, F.base64(F.lit(b"no sound at all"))).otherwise("")
    message = F.struct(F.col("title").alias("content"), F.struct(data.alias("data")).alias("audio"))
    body = F.when(k == 5, "<html>").otherwise(F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))))
    df = files.checked_speech(df.select("id", jsons.chat_content(body).alias("content"), jsons.speech_audio(body).alias("s")), "s")
    return df.select(F.col("id").alias("chapter_id"), "content", F.octet_length("s.audio").alias("sound_bytes"), "s.error")


@query(
    f"""SELECT id AS chapter_id, CASE id % 5 WHEN 0 THEN 'type=dict; choices=missing' WHEN 1 THEN 'finish_reason=stop; message=missing'
WHEN 2 THEN concat_ws('; ', CASE WHEN s <> '' THEN 'content=' || CASE WHEN length(s) > 240 THEN left(s, 237) || '...' ELSE s END END, 'audio=None', 'message_keys=content,role')
WHEN 3 THEN 'finish_reason=length; refusal=no; audio_keys=id,url; message_keys=audio,refusal' ELSE 'audio_keys=empty; message_keys=audio' END AS summary
FROM (SELECT id, {s_strip("regexp_replace(title, '[" + text.WS + "]+', ' ', 'g')")} AS s FROM chapters)"""
)
def str_response_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "chapters", "id", "title")
    k = F.col("id") % 5
    wrap = lambda x: F.to_json(F.struct(F.array(x).alias("choices")))
    body = (
        F.when(k == 0, '{"choices": []}').when(k == 1, '{"choices": [{"finish_reason": "stop"}]}')
        .when(k == 2, wrap(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("title").alias("content")).alias("message"))))
        .when(k == 3, '{"choices": [{"finish_reason": "length", "message": {"refusal": "no", "audio": {"url": "u", "id": 1}}}]}').otherwise('{"choices": [{"message": {"audio": {}}}]}')
    )
    return df.select(F.col("id").alias("chapter_id"), jsons.response_summary(body).alias("summary"))


# --- lists, maps, numbers ----------------------------------------------------------------
@query(
    f"""WITH t AS (SELECT id, list_transform(list_concat(tags, [' 有 声 书 ', '#经典']), lambda x: regexp_replace(regexp_replace(regexp_replace({s_strip('x')}, '^[#＃]+', ''), '[#＃]+$', ''), '[{text.WS}]+', '', 'g')) AS ts FROM chapters)
SELECT id AS chapter_id, array_to_string(list_filter(ts, lambda x, i: x <> '' AND list_position(ts, x) = i), ',') AS tags FROM t"""
)
def arr_default_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's tags and the default ones, first of equal ones, none cut."""
    both = F.concat("tags", F.array(F.lit(" 有 声 书 "), F.lit("#经典")))
    return table(spark, sf_dir, "chapters", "id", "tags").select(F.col("id").alias("chapter_id"), F.array_join(jsons.distinct_tags(both, None), ",").alias("tags"))


@query(
    f"""WITH t AS (SELECT id, list_filter(list_transform(tags, lambda x: {s_strip('x')}), lambda x: x <> '') AS ts FROM chapters)
SELECT id AS chapter_id, CASE id % 4 WHEN 0 THEN array_to_string(ts, ',') WHEN 2 THEN '1,a' ELSE '' END AS stored, CASE id % 4 WHEN 0 THEN array_to_string(ts, ',') END AS listed,
CASE id % 4 WHEN 2 THEN '[0] must be text' WHEN 0 THEN NULL ELSE 'must be a list of text values' END AS error FROM t"""
)
def arr_text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of texts as stored, leniently, and as configured, strictly."""
    k = F.col("id") % 4
    raw = F.when(k == 0, F.to_json("tags")).when(k == 1, "no list").when(k == 2, '[1, " a ", ""]').otherwise('{"a": 1}')
    df = table(spark, sf_dir, "chapters", "id", "tags").select("id", raw.alias("raw")).select("id", jsons.stored_tags("raw").alias("s"), jsons.text_list("raw").alias("l"))
    listed = F.when(F.col("l.error").isNull(), F.array_join("l.items", ","))
    return df.select(F.col("id").alias("chapter_id"), F.array_join("s", ",").alias("stored"), listed.alias("listed"), F.col("l.error").alias("error"))


@query(
    """SELECT id AS job_id, 'mine' AS provider, CAST(len(json_keys(options)) + CASE WHEN list_contains(json_keys(options), 'provider') THEN 0 ELSE 1 END AS BIGINT) AS entries, options ->> '$.target_lang' AS target_lang
FROM (SELECT DISTINCT id, options FROM jobs)"""
)
def jsn_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options with one entry set, the others kept."""
    df = table(spark, sf_dir, "jobs", "id", "options", once=True)
    m = jsons.overridden(F.from_json("options", "map<string,string>"), "provider", "mine")
    return df.select(F.col("id").alias("job_id"), m.alias("m")).select("job_id", F.col("m")["provider"].alias("provider"), long(F.size("m")).alias("entries"), F.col("m")["target_lang"].alias("target_lang"))


@query("SELECT j.id AS job_id, p.most, p.most IS NULL AS unknown FROM (SELECT DISTINCT id, kind FROM jobs) j LEFT JOIN (VALUES ('translate', 1200), ('tts', 900)) p(kind, most) ON p.kind = j.kind")
def jn_limits_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in a table of two rows; a kind that isn't there is told."""
    limits = spark.createDataFrame([("translate", 1200), ("tts", 900)], "kind string, most int")
    df = table(spark, sf_dir, "jobs", "id", "kind", once=True).join(F.broadcast(limits), "kind", "left")  # two rows
    return df.select(F.col("id").alias("job_id"), "most", F.col("most").isNull().alias("unknown"))


@query(
    """SELECT id AS job_id, CASE id % 4 WHEN 0 THEN least(30.0, (id % 50) + 0.5) WHEN 1 THEN least(30.0, CAST(id % 100 AS DOUBLE)) ELSE least(30.0, pow(2.0, completed_units % 7)) END AS delay, CAST(0.1 AS DOUBLE) * (completed_units % 3 + 1) AS speech_delay,
CAST(1 + greatest(0, failed_units - 1) AS BIGINT) AS attempts FROM (SELECT DISTINCT id, completed_units, failed_units FROM jobs)"""
)
def mth_retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the header asks for as a number or a date, else doubling; linear waits."""
    df = table(spark, sf_dir, "jobs", "id", "completed_units", "failed_units", "created_at", once=True)
    i = F.col("id")
    later = F.timestamp_seconds(F.unix_seconds(F.col("created_at").cast("timestamp")) + i % 100)
    header = F.when(i % 4 == 0, ((i % 50) + F.lit(0.5)).cast("string")).when(i % 4 == 1, F.date_format(later, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(i % 4 == 2, "soon")
    delay = jsons.retry_delay(F.col("completed_units") % 7, header, now=F.col("created_at").cast("timestamp"))
    return df.select(i.alias("job_id"), delay.alias("delay"), jsons.linear_delay(F.col("completed_units") % 3).alias("speech_delay"), long(jsons.attempts(F.col("failed_units") - 1)).alias("attempts"))


# --- rows, orders, states -------------------------------------------------------------------
@query(f"SELECT job_id, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY segment_index, id)) AS ids_md5 FROM {_SEGS} GROUP BY job_id")
def srt_segments_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each job in order."""
    s = _segments(spark, sf_dir).select("job_id", F.struct("segment_index", "id").alias("o"), F.col("id").cast("string").alias("t"))
    return segments.reassembled(s, ["job_id"], "o", "t", ",").select("job_id", _md5("text").alias("ids_md5"))


@query(
    f"""WITH l AS (SELECT chapter_id, max(id) AS job_id FROM jobs WHERE kind = 'tts' AND chapter_id IS NOT NULL GROUP BY chapter_id),
p AS (SELECT book_id, chapter_index, 0 AS a, 0 AS i, CAST(-1 AS BIGINT) AS b, audio_path AS p FROM chapters WHERE audio_path IS NOT NULL
UNION ALL SELECT c.book_id, c.chapter_index, 1, s.segment_index, s.id, s.output_path FROM chapters c JOIN l ON l.chapter_id = c.id JOIN {_SEGS} s ON s.job_id = l.job_id WHERE s.output_path IS NOT NULL),
d AS (SELECT book_id, p, min((chapter_index, a, i, b)) AS o FROM p WHERE p <> '' GROUP BY book_id, p)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY o, p) AS place, p AS path FROM d"""
)
def set_book_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound of a book in order, the first of equal paths."""
    newest = relational.latest(_jobs(spark, sf_dir).where("kind = 'tts' and chapter_id is not null").select("id", "chapter_id"), ["chapter_id"], "id")
    newest = newest.select(F.col("id").alias("job_id"), "chapter_id")
    s = _segments(spark, sf_dir, "output_path").where("output_path is not null").drop("chapter_id").join(newest, "job_id")
    c = table(spark, sf_dir, "chapters", "id", "book_id", "chapter_index", "audio_path").withColumnRenamed("id", "chapter_id")
    parts = s.join(c, "chapter_id").select("book_id", F.struct("chapter_index", F.lit(1).alias("a"), F.col("segment_index").alias("i"), F.col("id").alias("b")).alias("o"), F.col("output_path").alias("p"))
    whole = c.select("book_id", F.struct("chapter_index", F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit(-1).cast("bigint").alias("b")).alias("o"), F.col("audio_path").alias("p"))
    d = parts.unionByName(whole).where("p is not null and p <> ''").groupBy("book_id", "p").agg(F.min("o").alias("o"))
    return relational.placed(d, ["book_id"], ["o", "p"], "place").select("book_id", "place", F.col("p").alias("path"))


@query("SELECT id AS chapter_id, array_to_string(list_filter(l, lambda x, i: x IS NOT NULL AND x <> '' AND list_position(l, x) = i), ',') AS paths FROM (SELECT id, [audio_path, text_path, translation_path, audio_path] AS l FROM chapters)")
def arr_paths_of_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "chapters", "id", "audio_path", "text_path", "translation_path")
    paths = relational.ordered_paths(F.array("audio_path"), F.array("text_path", "translation_path", "audio_path"))
    return df.select(F.col("id").alias("chapter_id"), F.array_join(paths, ",").alias("paths"))


@query(
    f"""WITH l AS (SELECT chapter_id, max(id) AS job_id FROM jobs WHERE kind = 'tts' AND chapter_id IS NOT NULL GROUP BY chapter_id)
SELECT s.id AS segment_id, l.job_id, CAST(s.segment_index AS BIGINT) AS segment_index, s.output_path, '/api/chapters/' || CAST(l.chapter_id AS VARCHAR) || '/audio/segments/' || CAST(s.id AS VARCHAR) || '/download' AS url
FROM l JOIN {_SEGS} s ON s.job_id = l.job_id WHERE s.output_path IS NOT NULL"""
)
def prj_audio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = relational.latest(_jobs(spark, sf_dir).where("kind = 'tts' and chapter_id is not null").select("id", "chapter_id"), ["chapter_id"], "id")
    newest = newest.select(F.col("id").alias("job_id"), F.col("chapter_id").alias("chapter"))
    s = _segments(spark, sf_dir, "output_path").where("output_path is not null").join(newest, "job_id")
    return s.select(F.col("id").alias("segment_id"), "job_id", long("segment_index").alias("segment_index"), "output_path", names.segment_url("chapter", "id").alias("url"))


@query(
    f"""SELECT j.id AS job_id, status IN ('completed', 'completed_with_errors', 'failed', 'stopped') AS final, j.book_id = (SELECT min(id) FROM books) AS of_first, c.translation_path IS NOT NULL AS translated
FROM {_JOBS} j LEFT JOIN chapters c ON c.id = j.chapter_id"""
)
def flt_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "books", "id").agg(F.min("id").alias("first"))  # one row
    c = table(spark, sf_dir, "chapters", "id", "translation_path").select(F.col("id").alias("chapter_id"), F.col("translation_path").isNotNull().alias("t"))
    df = _jobs(spark, sf_dir).select("id", "book_id", "chapter_id", "status").join(c, "chapter_id", "left").join(F.broadcast(first))
    return df.select(F.col("id").alias("job_id"), display.is_final(F.col("status")).alias("final"), display.of_book(F.col("book_id"), F.col("first")).alias("of_first"), F.coalesce("t", F.lit(False)).alias("translated"))


@query("SELECT id AS chapter_id, book_id, CAST(chapter_index AS BIGINT) AS chapter_index, char_count, created_at FROM chapters")
def src_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept as text, given their types again."""
    df = table(spark, sf_dir, "chapters", "id", "book_id", "chapter_index", "char_count", "created_at")
    raw = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    return relational.typed(raw, "id bigint, book_id bigint, chapter_index bigint, char_count int, created_at timestamp_ntz").withColumnRenamed("id", "chapter_id")


@query(f"SELECT id AS job_id, TRUE AS stamped FROM {_JOBS}")
def dat_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows stamped with the time of the query, the same for all of them."""
    df = relational.stamped(_jobs(spark, sf_dir).select("id"))
    same = (F.col("created_at") == F.col("updated_at")) & (F.col("created_at") == F.current_timestamp())
    return df.select(F.col("id").alias("job_id"), same.alias("stamped"))


# --- changes of tables --------------------------------------------------------------------------
@query("SELECT count(*) AS matched FROM chapters WHERE id IN (SELECT chapter_id FROM jobs WHERE chapter_id IS NOT NULL)")
def agg_matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _jobs(spark, sf_dir).where("chapter_id is not null").select(F.col("chapter_id").alias("id"))
    return relational.matched_rows(table(spark, sf_dir, "chapters", "id"), changes, "id")


@query(
    f"""WITH p AS (SELECT chapter_id, {s_strip('title')} AS title, CAST(length(regexp_replace(text, '[{text.WS}]+', '', 'g')) AS INTEGER) AS n FROM parsed_chapters)
SELECT c.id AS chapter_id, coalesce(p.title, c.title) AS title, coalesce(p.n, c.char_count) AS char_count, CASE WHEN p.n IS NULL THEN c.translation_path END AS translation_path, CASE WHEN p.n IS NULL THEN c.translated_title END AS translated_title,
CASE WHEN p.n IS NULL THEN c.summary END AS summary, CASE WHEN p.n IS NULL THEN array_to_string(c.tags, ',') END AS tags, CASE WHEN p.n IS NULL THEN c.audio_path END AS audio_path, CAST(c.content_revision + CASE WHEN p.n IS NULL THEN 0 ELSE 1 END AS INTEGER) AS content_revision
FROM chapters c LEFT JOIN p ON p.chapter_id = c.id AND p.n <> c.char_count"""
)
def dml_edited_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose stored count is wrong are saved again: new count and title, next
    revision, and nothing of what was made from the old text."""
    made = {"translation_path": "string", "translated_title": "string", "summary": "string", "tags": "array<string>", "audio_path": "string"}
    c = table(spark, sf_dir, "chapters", "id", "title", "char_count", "content_revision", *made)
    p = table(spark, sf_dir, "parsed_chapters", "chapter_id", "title", "text").select(F.col("chapter_id").alias("id"), text.strip("title").alias("title"), text.char_count("text").cast("int").alias("char_count"))
    edits = p.join(c.select("id", F.col("char_count").alias("stored")), "id").where("char_count <> stored").drop("stored")
    return relational.edited_chapters(c, edits, made).withColumn("tags", F.array_join("tags", ",")).withColumnRenamed("id", "chapter_id")


_REVISION_SQL = """CASE WHEN json_type(options, '$.chapter_revision') IS NULL THEN 0 WHEN json_type(options, '$.chapter_revision') IN ('UBIGINT', 'BIGINT') AND CAST(options ->> '$.chapter_revision' AS BIGINT) >= 0 THEN CAST(options ->> '$.chapter_revision' AS BIGINT) END"""


@query(
    f"""WITH j AS (SELECT * FROM {_JOBS} QUALIFY row_number() OVER (PARTITION BY chapter_id, kind ORDER BY id DESC) = 1)
SELECT c.id AS chapter_id, CASE WHEN j.id IS NOT NULL THEN 'books/' || CAST(c.book_id AS VARCHAR) || '/new-' || CAST(j.id AS VARCHAR) ELSE c.translation_path END AS translation_path
FROM chapters c LEFT JOIN j ON j.chapter_id = c.id AND j.kind = 'translate' AND {_REVISION_SQL} = c.content_revision"""
)
def dml_promoted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of translate jobs that are still in force become the chapters'."""
    jobs = _jobs(spark, sf_dir).select("id", "book_id", "chapter_id", "kind", "options")
    results = jobs.where("kind = 'translate'").select(F.col("id").alias("job_id"), F.format_string("books/%d/new-%d", "book_id", "id").alias("translation_path"))
    c = table(spark, sf_dir, "chapters", "id", "content_revision", "translation_path")
    got = relational.promoted(c, jobs, "translate", jsons.revision(jsons.parsed("options"), "chapter_revision"), results)
    return got.select(F.col("id").alias("chapter_id"), "translation_path")


@query(
    f"""WITH g AS (SELECT c.id FROM chapters c JOIN parsed_books b ON b.book_id = c.book_id AND b.source_format = 'txt'), n AS (SELECT book_id AS id, book_id, title FROM parsed_books WHERE source_format = 'txt'),
c AS (SELECT id, book_id, title FROM chapters WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT * FROM n), j AS (SELECT id FROM {_JOBS} WHERE chapter_id IS NULL OR chapter_id NOT IN (SELECT id FROM g))
SELECT 'chapters' AS tab, count(*) AS n, CAST(sum(book_id) AS BIGINT) AS books FROM c UNION ALL SELECT 'jobs', count(*), NULL FROM j
UNION ALL SELECT 'segments', count(*), NULL FROM {_SEGS} WHERE chapter_id NOT IN (SELECT id FROM g) AND job_id IN (SELECT id FROM j)"""
)
def dml_replace_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of text books replaced; jobs and segments of the old ones go."""
    new = table(spark, sf_dir, "parsed_books", "book_id", "title", "source_format").where("source_format = 'txt'").select(F.col("book_id").alias("id"), "book_id", "title")
    tables = {"chapters": table(spark, sf_dir, "chapters", "id", "book_id", "title"), "jobs": _jobs(spark, sf_dir).select("id", "chapter_id"), "segments": _segments(spark, sf_dir).select("id", "job_id", "chapter_id")}
    links = [("chapters", "id", "jobs", "chapter_id"), ("chapters", "id", "segments", "chapter_id"), ("jobs", "id", "segments", "job_id")]
    left = relational.replaced_cascading(tables, new, "book_id", links)
    none = F.lit(None).cast("bigint")
    rows = [left[k].agg(F.count("*").alias("n"), (F.sum("book_id") if k == "chapters" else F.max(none)).alias("books")).select(F.lit(k).alias("tab"), "n", "books") for k in tables]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_PIECES = _SPLIT_SQL.format(key="chapter_id", norm=s_strip(s_unix("text")), src="parsed_chapters", n=1200).replace("md5(piece) AS piece_md5", "piece")


@query(
    f"""WITH p AS (SELECT chapter_id, {s_strip('piece')} AS piece FROM ({_PIECES})), n AS (SELECT chapter_id, count(*) AS n FROM p WHERE piece <> '' GROUP BY chapter_id)
SELECT c.chapter_id, coalesce(n.n, 0) AS total_units, CASE WHEN n.n IS NULL THEN 'failed' ELSE 'pending' END AS status, CASE WHEN n.n IS NULL THEN 'chapter has no translatable text' END AS error_message
FROM (SELECT chapter_id FROM parsed_chapters UNION ALL SELECT -1) c LEFT JOIN n ON n.chapter_id = c.chapter_id"""
)
def dml_segment_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs made for chapters; one without any text fails at once."""
    df = table(spark, sf_dir, "parsed_chapters", "chapter_id", "text")
    blank = spark.createDataFrame([(-1, " \n ")], "chapter_id bigint, text string")
    return pipeline.segment_jobs(df.unionByName(blank), "chapter_id", "text")[1]


@query(
    f"""SELECT chapter_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY segment_index) - 1 AS BIGINT) AS place, md5(piece) AS piece_md5
FROM (SELECT chapter_id, segment_index, {s_strip('piece')} AS piece FROM ({_PIECES})) WHERE piece <> ''"""
)
def tvf_trimmed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces without outer white space, blank ones dropped."""
    df = segments.segment_rows(table(spark, sf_dir, "parsed_chapters", "chapter_id", "text"), "chapter_id", "text", 1200, trim=True)
    return df.select("chapter_id", F.col("segment_index").alias("place"), _md5("segment_text").alias("piece_md5"))


@query(
    f"""SELECT chapter_id, CAST(len(p) AS BIGINT) AS pieces, md5(array_to_string(p, '|')) AS pieces_md5
FROM (SELECT chapter_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '') AS p FROM parsed_chapters)"""
)
def arr_stripped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "parsed_chapters", "chapter_id", "text").select("chapter_id", segments.stripped_pieces(F.split("text", "\n")).alias("p"))
    return df.select("chapter_id", long(F.size("p")).alias("pieces"), _md5(F.array_join("p", "|")).alias("pieces_md5"))


# --- external functions ------------------------------------------------------------------------------
@query(f"SELECT DISTINCT id AS segment_id, 'completed' AS status, CAST({len(_SILENCE)} AS BIGINT) AS bytes FROM segments")
def udf_fake_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "segments", "id", "source_text", once=True).withColumnRenamed("id", "segment_id")
    return apply_provider(df, "segment_id", "source_text", "fake speech", wait=linear(), result="binary").select("segment_id", "status", long(F.octet_length("result")).alias("bytes"))


def _no_sevens(prompts_of: list[str]) -> list[str]:
    if any("7" in p for p in prompts_of):
        raise ValueError("a seven")
    return [str(len(p)) for p in prompts_of]


@query(
    """SELECT id AS segment_id, CASE WHEN contains(source_text, '7') THEN 'failed' ELSE 'completed' END AS status, CASE WHEN NOT contains(source_text, '7') THEN CAST(length(source_text) AS VARCHAR) END AS result,
CASE WHEN contains(source_text, '7') THEN 'a seven' END AS error FROM (SELECT DISTINCT id, source_text FROM segments)"""
)
def udf_failing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that fails for some rows: these tell the error, the others go on."""
    df = table(spark, sf_dir, "segments", "id", "source_text", once=True).withColumnRenamed("id", "segment_id")
    return apply_provider(df, "segment_id", "source_text", _no_sevens, retries=0, wait=0.0)


# --- pipelines, whose SQL is that of their steps -------------------------------------------------------
def _chain(src: str, keys: str, col: str, steps: tuple[str, ...]) -> tuple[str, str]:
    """(CTEs, name of the last): ``col`` of ``src`` cleaned by steps, as ``t``."""
    out, last = [f"c0 AS (SELECT {keys}, {col} AS t FROM {src})"], "c0"
    for i, step in enumerate(steps, 1):
        p = last
        if step == "normalize_spacing":
            ls = f"string_split(translate({s_unix('t')}, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(8288), ''), chr(10))"
            body = s_strip(f"regexp_replace(array_to_string(list_transform({ls}, lambda x: {_tidy_sql('x')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")
            out.append(f"c{i} AS (SELECT {keys}, {body} AS t FROM {p})")
        elif step == "remove_repeated_noise_lines":
            out.append(f"a{i} AS (SELECT {keys}, t, {s_lines('t')} AS ls FROM {p})")
            out.append(f"n{i} AS (SELECT {keys}, t, ls, list_transform(list_filter(ls, lambda x: {s_noise('x')}), lambda x: {s_strip('x')}) AS noise FROM a{i})")
            out.append(f"o{i} AS (SELECT {keys}, t, ls, list_filter(list_distinct(noise), lambda k: len(list_filter(noise, lambda m: m = k)) >= 3) AS often FROM n{i})")
            out.append(f"f{i} AS (SELECT {keys}, t, ls, list_filter(ls, lambda x: NOT list_contains(often, {s_strip('x')})) AS kept FROM o{i})")
            out.append(f"c{i} AS (SELECT {keys}, CASE WHEN len(kept) = len(ls) THEN t ELSE array_to_string(kept, '') END AS t FROM f{i})")
        else:
            gone = s_watermark("x") if step == "remove_watermarks" else s_decor("x")
            out.append(f"a{i} AS (SELECT {keys}, t, {s_lines('t')} AS ls FROM {p})")
            out.append(f"f{i} AS (SELECT {keys}, t, ls, list_filter(ls, lambda x: NOT {gone}) AS kept FROM a{i})")
            out.append(f"c{i} AS (SELECT {keys}, CASE WHEN len(kept) = len(ls) THEN t ELSE array_to_string(kept, '') END AS t FROM f{i})")
        last = f"c{i}"
    return ", ".join(out), last


def _divided(src: str) -> str:
    """(book_id, chapter_index, title, text) of the texts ``t`` of ``src``."""
    return f"""t AS (SELECT book_id, {s_strip(s_unix('t'))} AS t FROM {src}),
l AS (SELECT book_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM t WHERE t <> ''),
h AS (SELECT book_id, line, n, (length({s_strip('line')}) BETWEEN 1 AND 80 AND regexp_matches({s_strip('line')}, '{_HEAD}')) AS head FROM l),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY n) AS sec, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY book_id) AS heads FROM h),
g AS (SELECT book_id, sec, heads, coalesce(max({s_strip('line')}) FILTER (WHERE head), '前言') AS title, {s_strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head), '')")} AS body FROM s GROUP BY book_id, sec, heads),
d AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY sec) - 1 AS chapter_index, title, body AS text FROM g WHERE heads >= 2 AND (sec > 0 OR body <> '')
UNION ALL SELECT book_id, i, '第 ' || CAST(i + 1 AS VARCHAR) || ' 段', substr(t, CAST(i * 6000 + 1 AS BIGINT), 6000)
FROM (SELECT book_id, t, unnest(range(0, CAST(ceil(length(t) / 6000.0) AS BIGINT))) AS i FROM t WHERE book_id NOT IN (SELECT book_id FROM g WHERE heads >= 2)))"""


def _measured(x: str) -> str:
    paragraphs = f"CAST(len(list_filter(string_split_regex({s_strip(x)}, '\\n[{text.WS}]*\\n'), lambda p: {s_strip('p')} <> '')) AS BIGINT)"
    return f"CAST(length(regexp_replace({x}, '[{text.WS}]+', '', 'g')) AS BIGINT) AS char_count, {paragraphs} AS paragraph_count"


_CLEAN, _LAST = _chain("parsed_books", "book_id", "full_text", pipeline.STEPS)


@query(f"WITH {_CLEAN}, {_divided(_LAST)} SELECT book_id, chapter_index, title, {_measured('text')} FROM d")
def plan_books_to_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, cut into chapters, measure: the whole text path of a book."""
    df = pipeline.books_to_chapters(table(spark, sf_dir, "parsed_books", "book_id", "full_text"))
    return df.select("book_id", "chapter_index", "title", "char_count", "paragraph_count")


_STEPS = ("remove_repeated_noise_lines", "remove_decorative_characters")
_OWN, _OWN_LAST = _chain("parsed_chapters", "book_id, chapter_index, title", "text", _STEPS)
_FILLED = s_strip("text") + " <> ''"


@query(
    f"""WITH w AS (SELECT b.book_id FROM parsed_books b LEFT JOIN (SELECT book_id, count(*) FILTER (WHERE {_FILLED}) AS filled, count(*) AS parts FROM parsed_chapters GROUP BY book_id) n ON n.book_id = b.book_id
WHERE (b.book_id % 3 = 0 AND filled >= 2) OR (b.book_id % 3 = 1 AND parts >= 2)),
own AS (WITH src AS (SELECT book_id, text, CASE WHEN book_id % 3 = 0 THEN coalesce(nullif({s_strip('title')}, ''), '第 ' || CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) AS VARCHAR) || ' 章') ELSE title END AS title,
row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) - 1 AS chapter_index FROM parsed_chapters WHERE book_id IN (SELECT book_id FROM w) AND (book_id % 3 = 1 OR {_FILLED})), {_OWN.replace('FROM parsed_chapters', 'FROM src')} SELECT * FROM {_OWN_LAST}),
divided AS (WITH {_chain('parsed_books', 'book_id', 'full_text', _STEPS)[0]}, {_divided(_OWN_LAST)} SELECT * FROM d WHERE book_id NOT IN (SELECT book_id FROM w))
SELECT book_id, chapter_index, title, {_measured('t')} FROM own UNION ALL SELECT book_id, chapter_index, title, {_measured('text')} FROM divided"""
)
def plan_stored_books_to_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and source chapters cleaned each by itself, texts as a whole."""
    df = pipeline.stored_books_to_chapters(_candidates(spark, sf_dir), _STEPS)
    return df.select("book_id", "chapter_index", "title", "char_count", "paragraph_count")


@query(
    f"""SELECT chapter_id, md5(string_agg('译文：' || piece, chr(10) || chr(10) ORDER BY segment_index)) AS text_md5
FROM (SELECT chapter_id, segment_index, {s_strip('piece')} AS piece FROM ({_PIECES})) WHERE piece <> '' GROUP BY chapter_id"""
)
def plan_translate_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut, translate piece by piece, put together."""
    df = pipeline.translated(table(spark, sf_dir, "parsed_chapters", "chapter_id", "text"), "chapter_id", "text", "fake")
    return df.select("chapter_id", _md5("text").alias("text_md5"))
