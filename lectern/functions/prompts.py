"""Prompts for models as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import blank_to_null, prompt_parts, strip

# The prompts' wording and how much of a text they quote.
TITLE_TASK = (
    "请基于以下章节内容生成中文章节名和章节简介。\n"
    "输出 JSON 对象，字段必须为 translated_title 和 summary。\n"
    "translated_title：中文章节名，简洁自然。\n"
    "summary：中文简介，用二到四句话概括当前章节，约 120 到 220 个汉字。"
    "请覆盖主要情节、关键人物或信息、情绪变化或章节作用，避免泛泛而谈。\n\n"
)
TAGS_TASK = (
    "请为当前章节生成适合音频平台发布和搜索检索的中文标签。\n"
    "输出 JSON 对象，字段必须为 tags，值为 5 到 10 个字符串。\n"
    "标签应覆盖作者/作品、体裁、主题、人物关系、情绪氛围、适听场景等。"
    "每个标签 2 到 8 个汉字，不要带 # 号，不要输出解释。"
)
SOURCE_EXCERPT, RESULT_EXCERPT, TAGS_EXCERPT = 1800, 2600, 2600


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def translation_template(prompt: Column | str, context: Column | str) -> Column:
    """What stands before the text to be translated, and its place."""
    return prompt_parts(prompt, context, F.lit("{source_text}"))


def title_prompt(title: Column | str, source: Column | str, result: Column | str) -> Column:
    """Asks for a chapter's title and summary, with excerpts of both texts."""
    return F.concat(
        F.lit(TITLE_TASK), F.lit("原章节名："), _or_empty(title), F.lit("\n\n原文节选：\n"), F.left(_or_empty(source), F.lit(SOURCE_EXCERPT)),
        F.lit("\n\n译文节选：\n"), F.left(_or_empty(result), F.lit(RESULT_EXCERPT)),
    )


def tags_prompt(title: Column | str, translated_title: Column | str, summary: Column | str, text: Column | str, context: Column | str) -> Column:
    """Asks for a chapter's tags; the context is a line of its own if not blank."""
    about = F.coalesce(F.concat(F.lit("\n发布背景："), blank_to_null(_c(context))), F.lit(""))
    return F.concat(
        F.lit(TAGS_TASK), about, F.lit("\n\n原章节名："), _or_empty(title), F.lit("\n中文章节名："), _or_empty(translated_title),
        F.lit("\n章节简介："), _or_empty(summary), F.lit("\n\n正文节选：\n"), F.left(_or_empty(text), F.lit(TAGS_EXCERPT)),
    )


def speech_context(context: Column | str, style: Column | str, tone: Column | str, background: Column | str) -> Column:
    """How a text is to be read: the parts that aren't blank, a line each."""
    said = lambda label, x: F.concat(F.lit(f"{label}: "), blank_to_null(_c(x)))
    return F.concat_ws("\n", F.nullif(strip(_c(context)), F.lit("")), said("Narration style", style), said("Character tone", tone), said("Work background", background))
