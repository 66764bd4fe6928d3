import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import display, jsons, names, prompts, text
from lectern.operators import chapters, cleaning

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


def test_strip_is_unicode(spark):
    for s in ["", SPACES, SPACES + "a b" + SPACES, "a​", "　第一章　"]:
        assert one(spark, s, text.strip) == s.strip()
    assert one(spark, None, text.strip) is None


def test_lines_keep_their_ends(spark):
    for s in ["a\r\nb\rc\nd", "a\x1cb\x85c d", "\n\n", "x", "a\r"]:
        got = [x for x in one(spark, s, text.lines_with_ends) if x]
        assert got == s.splitlines(keepends=True)


@pytest.mark.parametrize(("t", "chars", "paragraphs"), [("河上有雾\n\n船还没来\n他等着", 11, 2), ("", 0, 0), ("\n \n\t\n", 0, 0), ("ab\n　\ncd e", 5, 2)])
def test_metadata(spark, t, chars, paragraphs):
    assert (one(spark, t, text.char_count), one(spark, t, text.paragraph_count)) == (chars, paragraphs)


def test_strip_looks_at_the_ends_only(spark):
    """Much white space inside costs nothing."""
    t = "　 a" + " \t" * 100_000 + "b \u2003"
    started = time.perf_counter()
    assert one(spark, t, text.strip) == t.strip()
    assert one(spark, t, text.char_count) == 2
    assert time.perf_counter() - started < 10


@pytest.mark.parametrize(
    ("op", "src", "want", "removed"),
    [
        ("remove_watermarks", "雾散了\n更多精彩请看 m.books.example\n他上了船\n微信公众号：渡口\n船开了", "雾散了\n他上了船\n船开了", 2),
        ("remove_watermarks", "信里写着 shop.top 三个词。", "信里写着 shop.top 三个词。", 0),
        ("remove_watermarks", "【 https://a.example/x 】\n桥下", "桥下", 1),
        ("remove_watermarks", "一行\n\n又一行\n", "一行\n\n又一行\n", 0),
        ("normalize_spacing", "渡口\u200b　　清晨\t\t有雾\n\n\n\n\n船夫来了  ", "渡口清晨有雾\n\n船夫来了", 3),
        ("normalize_spacing", "他说 “ok” 然后 走", "他说 “ok” 然后走", 0),
        ("remove_repeated_noise_lines", "推广：渡口书屋\n甲\n推广：渡口书屋\n乙\n 推广：渡口书屋\n丙", "甲\n乙\n丙", 3),
        ("remove_repeated_noise_lines", "走吧。\na\n走吧。\nb\n走吧。", "走吧。\na\n走吧。\nb\n走吧。", 0),
        ("remove_decorative_characters", "桥上\n~~~~~~~~\n·····—\n桥下", "桥上\n桥下", 2),
        ("remove_decorative_characters", "", "", 0),
    ],
)
def test_cleaners(spark, op, src, want, removed):
    r = one(spark, src, cleaning.CLEANERS[op])
    assert (r.text, r.removed_lines) == (want, removed)


def test_chain_and_unknown(spark):
    df = spark.createDataFrame([("下载地址 b.example\n船\u200b  夫",), (None,)], "t string")
    rows = cleaning.cleaned(df, "t", ["remove_watermarks", "normalize_spacing"]).collect()
    assert rows[0].clean_text == "船夫" and [s.operation for s in rows[0].clean_stats] == ["remove_watermarks", "normalize_spacing"]
    assert rows[1].clean_text is None
    with pytest.raises(ValueError, match="Unknown text cleaning operation: polish"):
        cleaning.cleaned(df, "t", ["polish"])
    parts = F.array(F.struct(F.lit("A").alias("title"), F.col("t").alias("text")))
    each = df.select(chapters.cleaned_chapters(parts, cleaning.clean_with("remove_watermarks", "normalize_spacing")).alias("c")).collect()
    assert [r.c[0].text for r in each] == ["船夫", None]


def _titles(spark, t, n=6000):
    return [c.title for c in one(spark, t, lambda c: chapters.chapters_of(c, n))]


def test_chapters(spark):
    assert _titles(spark, "楔子\n雾\n第3回 渡口\n船\n第四回 上岸\n灯") == ["楔子", "第3回 渡口", "第四回 上岸"]
    got = one(spark, "手稿\n抄本\n第3回 渡口\n船\n第四回 上岸\n灯", chapters.chapters_of)
    assert [c.title for c in got] == ["前言", "第3回 渡口", "第四回 上岸"] and got[0].text == "手稿\n抄本"
    sized = one(spark, "舟" * 17, lambda c: chapters.chapters_of(c, 7))
    assert [(c.title, len(c.text)) for c in sized] == [("第 1 段", 7), ("第 2 段", 7), ("第 3 段", 3)]
    lone = "第9回 独章\n雾中无人"
    assert "".join(c.text for c in one(spark, lone, lambda c: chapters.chapters_of(c, 4))) == lone
    for a, b in [("Section 8", "Part 9"), ("Book XII", "Chapter iv"), ("3) Fog", "IX. Ferry"), ("卷 七", "卷八 渡"), ("序章", "后记")]:
        assert _titles(spark, f"{a}\nfog\n{b}\nferry") == [a, b]
    assert one(spark, "", chapters.chapters_of) == []
    assert one(spark, "第8回\n第9回", chapters.chapters_of)[0].text == ""


def test_names(spark):
    assert one(spark, "c:\\up\\fog.epub", names.upload_name) == "fog.epub"
    assert one(spark, "../../ferry.txt", names.upload_name) == "ferry.txt"
    assert one(spark, "..", names.upload_name) is None
    for p, ok in [("a/b.txt", True), ("/a", False), ("a/../b", False), ("", False), ("a\\b", False), ("a/./b", True), ("./.", False)]:
        assert (one(spark, p, names.safe_relative) is not None) == ok, p
    row = spark.range(1).select(names.audio_path(F.lit(1), F.lit(0), F.lit(2), F.lit("wav"), F.lit(9)).alias("a"), names.audio_path(F.lit(1), F.lit(-1), F.lit(2)).alias("b"), names.number(F.lit(12345)).alias("c")).first()
    assert (row.a, row.b, row.c) == ("books/1/audio/0000/jobs/9/0002.wav", None, "12345")
    got = spark.range(1).select(names.download_name(F.lit(" Fog / Ferry "), F.lit("II: what?"), F.lit(0)).alias("a")).first().a
    assert got == "Fog Ferry - II what.wav"


def test_options_are_type_strict(spark):
    rows = ["{}", '{"r":0}', '{"r":5}', '{"r":"5"}', '{"r":true}', '{"r":-1}', '{"r":1.0}', '{"r":null}', "", None, "no json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, o string").withColumn("v", jsons.parsed("o"))
    got = [r.x for r in df.orderBy("i").select(jsons.revision(F.col("v"), "r").alias("x")).collect()]
    assert got[:7] == [0, 0, 5, None, None, None, None] and got[8:10] == [0, 0]
    assert one(spark, '{"merge":0}', lambda c: jsons.truthy(jsons.parsed(c), "merge")) is False
    assert one(spark, "{}", lambda c: jsons.truthy(jsons.parsed(c), "merge")) is True


def test_answers(spark):
    fence = "```json\n{\"tags\": [\"#渡 口\", \"渡口\", \"雾＃\"]}\n```"
    assert one(spark, fence, jsons.answer_tags) == ["渡口", "雾"]
    assert one(spark, '["fog","fog","ferry"]', jsons.answer_tags) == ["fog", "ferry"]
    assert one(spark, "雾，船、桥\n灯", jsons.answer_tags) == ["雾", "船", "桥", "灯"]
    assert len(one(spark, ",".join(f"w{i}" for i in range(14)), jsons.answer_tags)) == 10
    assert one(spark, 'Sure: {"title": " Fog "} done', lambda c: jsons.answer_field(c, "title")) == "Fog"
    assert one(spark, '{"choices":[{"message":{"content":" fog\\n"}}]}', jsons.chat_content) == "fog"
    assert one(spark, '{"choices":[{"message":{"content":[1]}}]}', jsons.chat_content) is None
    errors = [one(spark, f'{{"choices":[{{"message":{{"audio":{{"data":"{d}"}}}}}}]}}', jsons.speech_audio).error for d in ("", "?", "AAAA", "UklGRgAAAABXQVZF")]
    assert errors == ["missing audio", "invalid base64", "not a WAV file", None]
    assert one(spark, "tell {source_text}", lambda c: text.filled_template(c, F.lit("f{o}g"))) == "tell f{o}g"
    assert one(spark, "tell {name}", lambda c: text.filled_template(c, F.lit("a"))) is None


def test_error_texts_and_summaries(spark):
    said = lambda body: one(spark, body, lambda c: jsons.error_text(F.lit(429), F.lit("Too Many"), c))
    assert [said(b) for b in ('{"error":{"message":" slow down "}}', '{"error":{"message":" "}}', '{"error":"x"}', "[]", "busy")] == ["slow down", "HTTP 429: Too Many", "HTTP 429: Too Many", "HTTP 429: Too Many", "HTTP 429: busy"]
    assert one(spark, "{}", jsons.response_summary) == "type=dict; choices=missing" and one(spark, None, jsons.response_summary) == "type=dict; choices=missing"
    assert one(spark, '{"choices":[{"message":{"content":"a  b","role":"x"}}]}', jsons.response_summary) == "content=a b; audio=None; message_keys=content,role"


def test_lists(spark):
    lists = [one(spark, v, jsons.text_list) for v in ('["a "," ","b"]', "null", None, "[]", '["a",2]', '"a"', "{")]
    assert [(r["items"], r.error) for r in lists] == [(["a", "b"], None), ([], None), ([], None), ([], None), (None, "[1] must be text"), (None, "must be a list of text values"), (None, "must be a list of text values")]
    assert [one(spark, v, jsons.stored_tags) for v in ('[" a",2,""]', "{}", None, "x")] == [["a", "2"], [], [], []]
    m = spark.createDataFrame([({"a": "1"},), ({},), (None,)], "m map<string,string>").select(jsons.overridden(F.col("m"), "a", "2").alias("r")).collect()
    assert [r.r for r in m] == [{"a": "2"}, {"a": "2"}, None]


def test_display(spark):
    rows = [(0, 0, "x"), (1, 3, ""), (2, 3, None), (5, 3, "failed"), (1, -1, "paused")]
    df = spark.createDataFrame(rows, "c int, t int, s string")
    got = df.select(display.progress_percent(F.col("c"), F.col("t")).alias("p"), display.status_label(F.col("s")).alias("l"), display.is_final(F.col("s")).alias("f")).collect()
    assert [(r.p, r.l, r.f) for r in got] == [(0, "x", False), (33, "未知", False), (67, "未知", False), (100, "失败", True), (0, "已暂停", False)]
    assert [one(spark, n, display.word_count_label, "int") for n in (2469, 0, -4, None)] == ["1,235", "0", "0", "0"]


def test_prompts(spark):
    got = spark.range(1).select(
        prompts.title_prompt(F.lit("T"), F.lit("s" * 2000), F.lit(None).cast("string")).alias("a"), prompts.tags_prompt("id", F.lit(None).cast("string"), F.lit("u"), F.lit("x" * 3000), F.lit(" ")).alias("b"),
        prompts.speech_context(F.lit(" calm "), F.lit(" "), F.lit("warm"), F.lit(None).cast("string")).alias("c"),
    ).first()
    assert got.a.startswith(prompts.TITLE_TASK) and got.a.count("s") >= 1800 and "s" * 1801 not in got.a and got.a.endswith("译文节选：\n")
    assert "发布背景" not in got.b and got.b.endswith("x" * 2600) and "章节简介：u" in got.b
    assert got.c == "calm\nCharacter tone: warm"


def test_retry_after(spark):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    rows = [("0", 0.0), ("2.5", 2.5), ("Wed, 01 Jan 2025 00:00:10 GMT", 10.0), ("Tue, 31 Dec 2024 00:00:00 GMT", 0.0), ("soon", None), (None, None)]
    got = [one(spark, v, lambda c: jsons.retry_after(c, now)) for v, _ in rows]
    assert got == [w for _, w in rows]
    assert [one(spark, v, lambda c: jsons.retry_delay(F.lit(7), c, now=now)) for v in ("100", None)] == [30.0, 30.0]
