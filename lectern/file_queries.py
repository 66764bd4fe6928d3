"""Queries that write files from the test tables and read them back through the
readers, each beside its SQL over the tables.

The files lie in the shared folder and go when the driver ends.
"""

from __future__ import annotations

import html
import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import names, text
from lectern.operators import audio, chapters
from lectern.operators.partitioning import drop_at_exit, shared_dir
from lectern.queries import _samples, long, query, s_lines, s_strip, s_unix, table
from lectern.sources import files, sinks


def _folder(spark: SparkSession, df: DataFrame) -> str:
    """A new folder with the files (path, content) of a table."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    drop_at_exit(spark, root)
    failed = sinks.written_one_by_one(df.select("path", "content"), root).where("error is not null").count()
    if failed:
        raise OSError(f"{failed} files could not be written")
    return root


def _id_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("bigint")


def _md5(c: Column | str) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


# --- plain texts -------------------------------------------------------------------
_MOST = 40_000
_BODY = s_strip(s_unix("full_text"))


@query(
    f"""WITH b AS (SELECT book_id, full_text, octet_length(encode(full_text)) + CASE book_id % 5 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS size FROM parsed_books)
SELECT book_id, 'book ' || CAST(book_id AS VARCHAR) AS title, CASE WHEN size > {_MOST} AND book_id % 5 <> 3 THEN 'file too large' WHEN book_id % 5 = 2 THEN 'not UTF-8' WHEN book_id % 5 = 3 OR {_BODY} = '' THEN 'empty file' END AS error,
CASE WHEN (size <= {_MOST} AND book_id % 5 NOT IN (2, 3) AND {_BODY} <> '') THEN md5({_BODY}) END AS text_md5 FROM b"""
)
def src_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files with and without byte-order mark, broken, blank and too large."""
    df = table(spark, sf_dir, "parsed_books", "book_id", "full_text")
    raw = F.col("full_text").cast("binary")
    k = F.col("book_id") % 5
    content = F.when(k == 1, F.concat(F.lit(b"\xef\xbb\xbf"), raw)).when(k == 2, F.concat(raw, F.lit(b"\xff\xfe"))).when(k == 3, F.lit(b" \r\n ")).otherwise(raw)
    root = _folder(spark, df.select(F.format_string("t/book %d.TXT", "book_id").alias("path"), content.alias("content")))
    got = files.read_text_books(spark, f"{root}/t", most=_MOST)
    return got.select(_id_of().alias("book_id"), "title", "error", _md5("full_text").alias("text_md5"))


@query("SELECT chapter_id, book_id, md5(text) AS text_md5 FROM parsed_chapters")
def snk_text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written by partition, one book replaced in place, and read again."""
    df = table(spark, sf_dir, "parsed_chapters", "chapter_id", "book_id", "text")
    at = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    drop_at_exit(spark, at)
    low = F.col("book_id") % 8
    rows = df.select(F.col("chapter_id"), F.col("book_id"), "text", low.alias("part"))
    sinks.write_texts(rows.withColumn("text", F.when(F.col("part") == 3, "old").otherwise(F.col("text"))), at, ["part"])
    sinks.write_texts(rows.where("part = 3"), at, ["part"])
    return spark.read.schema(rows.schema).parquet(at).select("chapter_id", "book_id", _md5("text").alias("text_md5"))


# --- pages and e-books ----------------------------------------------------------------
_LINES = f"list_filter(list_transform({s_lines('t')}, lambda x: {s_strip('x')}), lambda x: x <> '')"


@query(
    f"""WITH d AS (SELECT doc_id, text AS t, coalesce(nullif({s_strip("'Page ' || CAST(doc_id AS VARCHAR)")}, ''), '') AS title FROM documents)
SELECT doc_id, md5(array_to_string(list_concat(CASE doc_id % 3 WHEN 0 THEN [title] WHEN 1 THEN [title, 'Other'] ELSE CAST([] AS VARCHAR[]) END, {_LINES}), chr(10))) AS text_md5,
CASE WHEN doc_id % 3 < 2 THEN title END AS title FROM d"""
)
def src_pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a title in the head, with a heading as well, with neither."""
    df = table(spark, sf_dir, "documents", "doc_id", "text")
    title = F.concat(F.lit("Page "), F.col("doc_id").cast("string"))
    head = F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("<title> "), title, F.lit("</title>"))).otherwise("")
    first = F.when(F.col("doc_id") % 3 == 1, "<h1>Other</h1>").otherwise("")
    page = F.concat(F.lit("<html><head>"), head, F.lit("<style>p {}</style><script>var a = '<p>';</script></head><body>"), first, F.lit("<p>"), text.html_escaped("text"), F.lit("</p></body></html>"))
    got = files.pages_text(df.select("doc_id", page.alias("html")))
    return got.select("doc_id", _md5("page_text").alias("text_md5"), F.col("page_title").alias("title"))


def _epub(form: int, parts: list[tuple[int, str, str]]) -> bytes:
    """An e-book of (index, title, text): contents as NCX with nested points (0), as
    a navigation page that leaves the last part out (1), none with page titles (2),
    none without any title (3)."""
    buf = io.BytesIO()
    item = lambda i, k="application/xhtml+xml", p="": f'<item id="i{i}" href="t/part%20{i}.xhtml" media-type="{k}"{p}/>'
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>')
        more, toc = "", ""
        if form == 0:
            more, toc = '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', ' toc="ncx"'
            point = lambda i, t, inner: f'<navPoint><navLabel><text> {html.escape(t)} </text></navLabel><content src="./t/part%20{i}.xhtml#a"/>{inner}</navPoint>'
            tree = ""
            for i, t, _ in reversed(parts):  # each part below the one before it
                tree = point(i, t, tree)
            z.writestr("O/toc.ncx", f'<ncx xmlns="urn:n"><navMap>{tree}{point(parts[0][0], "given twice", "")}</navMap></ncx>')
        if form == 1:
            more = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
            links = "".join(f'<li><a href="t/part%20{i}.xhtml">{html.escape(t)}</a></li>' for i, t, _ in parts[: max(1, len(parts) - 1)])
            z.writestr("O/nav.xhtml", f"<html xmlns='urn:h'><body><nav><ol>{links}</ol></nav></body></html>")
        spine = ('<itemref idref="nav"/>' if form == 1 else "") + "".join(f'<itemref idref="i{i}"/>' for i, _, _ in parts)
        z.writestr("O/b.opf", f'<package xmlns="urn:o"><manifest>{more}{"".join(item(i) for i, _, _ in parts)}</manifest><spine{toc}>{spine}</spine></package>')
        for i, t, body in parts:
            head = f"<title>{html.escape(t)}</title>" if form == 2 else ""
            z.writestr(f"O/t/part {i}.xhtml", f"<html><head>{head}<script>x()</script></head><body><p>{html.escape(body)}</p></body></html>")
    return buf.getvalue()


def _ebooks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for book, parts in zip(f["book_id"], f["parts"]):
            broken = book % 7 == 0
            rows.append((f"e/{book}.epub", b"no e-book" if broken else _epub(book % 4, [(p["chapter_index"], p["title"], p["text"]) for p in parts])))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(
    f"""WITH c AS (SELECT book_id, chapter_index, title, text AS t, max(chapter_index) OVER (PARTITION BY book_id) AS last, min(chapter_index) OVER (PARTITION BY book_id) AS first FROM parsed_chapters WHERE book_id % 7 <> 0),
k AS (SELECT book_id, chapter_index, {s_strip('title')} AS title, {_LINES} AS ls, book_id % 4 AS form, (book_id % 4 = 1 AND chapter_index = last AND last > first) AS out FROM c),
p AS (SELECT *, CASE WHEN form = 2 THEN list_concat([title], ls) ELSE ls END AS own FROM k WHERE NOT out)
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) - 1 AS BIGINT) AS chapter_index, CASE WHEN form = 3 THEN ls[1] ELSE title END AS title, md5(array_to_string(own, chr(10))) AS text_md5, CAST(NULL AS VARCHAR) AS error FROM p WHERE len(own) > 0
UNION ALL SELECT DISTINCT book_id, CAST(NULL AS BIGINT), NULL, NULL, 'could not parse EPUB' FROM parsed_chapters WHERE book_id % 7 = 0"""
)
def src_epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-books with each kind of contents, and broken files."""
    df = table(spark, sf_dir, "parsed_chapters", "book_id", "chapter_index", "title", "text")
    books = df.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "title", "text"))).alias("parts"))  # a book is one file
    root = _folder(spark, books.mapInPandas(_ebooks, "path string, content binary"))
    got = files.read_epub_chapters(files.binary_files(spark, f"{root}/e"))
    return got.select(_id_of().alias("book_id"), long("chapter_index").alias("chapter_index"), "title", _md5("text").alias("text_md5"), "error")


# --- chapters of a book ------------------------------------------------------------------
_FORM = "CASE WHEN book_id % 3 = 0 THEN 'stored' WHEN book_id % 3 = 1 THEN 'source' ELSE 'text' END"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, stored JSON, source array, full_text): a third of the books has its
    chapters stored, a third a source file with chapters, all a text."""
    c = table(spark, sf_dir, "parsed_chapters", "book_id", "chapter_index", "title", "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "title", "text"))), lambda x: F.struct(x.title.alias("title"), x.text.alias("text")))
    per = c.groupBy("book_id").agg(parts.alias("parts"))
    df = table(spark, sf_dir, "parsed_books", "book_id", "full_text").join(per, "book_id", "left")
    none = F.array().cast(chapters.ARRAY)
    k = F.col("book_id") % 3
    return df.select(
        "book_id", F.when(k == 0, chapters.chapters_json(F.col("parts"))).otherwise("[]").alias("stored"), F.when(k == 1, F.coalesce("parts", none)).otherwise(none).alias("source"), "full_text"
    )


@query(
    f"""WITH n AS (SELECT book_id, count(*) FILTER (WHERE {s_strip('text')} <> '') AS filled, count(*) AS parts FROM parsed_chapters GROUP BY book_id),
f AS (SELECT b.book_id, CASE WHEN b.book_id % 3 = 0 AND filled >= 2 THEN 'stored' WHEN b.book_id % 3 = 1 AND parts >= 2 THEN 'source' ELSE 'text' END AS form FROM parsed_books b LEFT JOIN n ON n.book_id = b.book_id)
SELECT f.book_id, f.form, row_number() OVER (PARTITION BY c.book_id ORDER BY c.chapter_index) - 1 AS chapter_index,
CASE WHEN form = 'stored' THEN coalesce(nullif({s_strip('title')}, ''), '第 ' || CAST(row_number() OVER (PARTITION BY c.book_id ORDER BY c.chapter_index) AS VARCHAR) || ' 章') ELSE title END AS title, md5(c.text) AS text_md5
FROM f JOIN parsed_chapters c ON c.book_id = f.book_id AND f.form <> 'text' WHERE f.form = 'source' OR {s_strip('c.text')} <> ''
UNION ALL SELECT book_id, form, 0, NULL, NULL FROM f WHERE form = 'text'"""
)
def src_chapters_to_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chapters, else the source file's, else the text divided (of which
    ``tvf_split_chapters`` shows the division)."""
    df = _candidates(spark, sf_dir)
    got = chapters.chapters_to_divide(F.col("stored"), F.col("source"), F.col("full_text"))
    by_text = chapters.chapters_of(F.col("full_text"))
    form = F.when((F.col("book_id") % 3 == 0) & (F.size(chapters.stored_chapters(F.col("stored"))) >= 2), "stored").when((F.col("book_id") % 3 == 1) & (F.size("source") >= 2), "source").otherwise("text")
    rows = df.select("book_id", form.alias("form"), got.alias("c"), (got == by_text).alias("divided"))
    parts = rows.where("form <> 'text'").select("book_id", "form", F.posexplode_outer("c").alias("i", "x")).where("x is not null")
    parts = parts.select("book_id", "form", long("i").alias("chapter_index"), "x.title", _md5("x.text").alias("text_md5"))
    nothing = F.lit(None).cast("string")
    rest = rows.where("form = 'text' and divided").select("book_id", "form", F.lit(0).cast("bigint").alias("chapter_index"), nothing.alias("title"), nothing.alias("text_md5"))
    return parts.unionByName(rest)


# --- sound -----------------------------------------------------------------------------------
@query(
    """SELECT vec_id, CAST(len(embedding) // (1 + vec_id % 2) AS BIGINT) AS frames, CASE WHEN vec_id % 5 = 4 THEN NULL ELSE round(CAST(len(embedding) // (1 + vec_id % 2) AS DOUBLE) / 1000, 3) END AS seconds,
CASE WHEN vec_id % 5 = 4 THEN 'unreadable' END AS error, CASE WHEN vec_id % 5 <> 4 THEN (SELECT sum(CAST(floor(CAST(x AS DOUBLE) * 32768) AS INTEGER)) FROM (SELECT unnest(embedding[1:(len(embedding) // (1 + vec_id % 2)) * (1 + vec_id % 2)]) AS x)) END AS total FROM embeddings WHERE vec_id % 5 <> 4
UNION ALL SELECT vec_id, NULL, NULL, 'unreadable', NULL FROM embeddings WHERE vec_id % 5 = 4"""
)
def src_wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound files of one and two channels, and broken ones, written and read."""
    df = _samples(spark, sf_dir).withColumn("channels", (1 + F.col("vec_id") % 2).cast("int"))
    whole = F.slice("samples", 1, (F.floor(F.size("samples") / F.col("channels")) * F.col("channels")).cast("int"))
    df = files.wav_bytes(df.withColumn("samples", whole))
    content = F.when(F.col("vec_id") % 5 == 4, F.lit(b"RIFF")).otherwise(F.col("content"))
    root = _folder(spark, df.select(F.format_string("w/%d.wav", "vec_id").alias("path"), content.alias("content")))
    got = files.read_wav(files.binary_files(spark, f"{root}/w"))
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return got.select(_id_of().alias("vec_id"), long("frames").alias("frames"), F.col("duration_seconds").alias("seconds"), "error", total.alias("total"))


@query(
    """WITH e AS (SELECT vec_id, vec_id // 6 AS album, CASE WHEN (vec_id // 6) % 4 = 3 AND vec_id % 6 = 5 THEN 2 ELSE 1 END AS rate, embedding FROM embeddings),
s AS (SELECT vec_id, album, rate, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 32768) AS INTEGER) AS x, generate_subscripts(embedding, 1) AS i FROM e),
r AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, abs(x) <= 3000 ORDER BY i) AS isl FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, abs(x) <= 3000, isl ORDER BY i) AS place FROM r),
f AS (SELECT * FROM k WHERE abs(x) > 3000 OR place <= 2)
SELECT album, (SELECT count(*) FROM e WHERE e.album = f.album) AS parts, count(*) AS frames, md5(string_agg(CAST(x AS VARCHAR), ',' ORDER BY vec_id, i)) AS samples_md5 FROM f GROUP BY album HAVING (SELECT count(DISTINCT rate) FROM e WHERE e.album = f.album) = 1"""
)
def aud_collapse_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of the parts collapsed, then the parts put together; an album whose
    parts differ in rate gives no sound."""
    album = F.expr("vec_id div 6")
    odd = (album % 4 == 3) & (F.col("vec_id") % 6 == 5)
    df = _samples(spark, sf_dir).withColumn("album", album).withColumn("sample_rate", F.when(odd, 1001).otherwise(1000))
    got = audio.merged_audio(df, ["album"], "vec_id", ms=2, threshold=3000)
    joined = F.array_join(F.transform("samples", lambda x: x.cast("string")), ",")
    return got.select("album", "parts", long(F.size("samples")).alias("frames"), _md5(joined).alias("samples_md5"))


@query(
    """WITH s AS (SELECT vec_id, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 32768) AS INTEGER) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
f AS (SELECT vec_id, (i - 1) // 2 AS f, max(abs(x)) AS top, count(*) AS n FROM s GROUP BY 1, 2)
SELECT vec_id, count(*) FILTER (WHERE top <= 3000) AS silent, greatest(1, CAST(floor((1000 + vec_id) * 1.2) AS BIGINT)) AS budget FROM f WHERE n = 2 GROUP BY vec_id"""
)
def flt_silent_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two channels that are silent, and how many frames a silence may last."""
    df = _samples(spark, sf_dir)
    n = F.floor(F.size("samples") / 2).cast("int")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("samples", i * 2 + 1, F.lit(2)))
    silent = F.size(F.filter(frames, lambda f: audio.is_silent(f, 3000)))
    return df.select("vec_id", long(silent).alias("silent"), long(audio.silence_budget(1000 + F.col("vec_id"))).alias("budget"))


@query(
    """SELECT id AS book_id, 'books/' || CAST(id AS VARCHAR) || '/' || list_last(string_split(replace(original_filename, chr(92), '/'), '/')) AS source, 'books/' || CAST(id AS VARCHAR) || '/filtered.txt' AS filtered,
'books/' || CAST(id AS VARCHAR) || '/cleaned.txt' AS cleaned, 'books/' || CAST(id AS VARCHAR) || '/structured-chapters.json' AS structured, 'books/' || CAST(id AS VARCHAR) || '/chapters/' || format('{:04d}', id * 77) || '.txt' AS chapter,
'books/' || CAST(id AS VARCHAR) || '/chapters/split-9/' || format('{:04d}', id % 5) || '.txt' AS staged FROM books"""
)
def prj_book_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "books", "id", "original_filename")
    i = F.col("id")
    return df.select(
        i.alias("book_id"), names.source_path("id", "original_filename").alias("source"), names.filtered_path("id").alias("filtered"), names.cleaned_path("id").alias("cleaned"),
        names.structured_path("id").alias("structured"), names.chapter_path("id", i * 77).alias("chapter"), names.staged_path("id", F.lit(9), i % 5).alias("staged"),
    )
