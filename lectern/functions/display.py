"""What is shown of counts and states, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of states.
STATUS_LABELS = {
    "pending": "等待中", "running": "运行中", "paused": "已暂停", "completed": "已完成", "completed_with_errors": "部分完成", "failed": "失败", "stopped": "已停止",
}
UNKNOWN = "未知"
#: States that nothing follows.
FINAL = ("completed", "completed_with_errors", "failed", "stopped")


def word_count_label(char_count: Column) -> Column:
    """Half the characters, half up, with thousands separators; 0 if not positive."""
    return F.format_number(F.coalesce(F.greatest(F.lit(0), F.floor(char_count / 2.0 + 0.5)), F.lit(0)), 0)


def progress_percent(completed: Column, total: Column) -> Column:
    share = F.floor(100.0 * completed / F.nullif(total, F.lit(0)) + 0.5)
    return F.when((total <= 0) | (completed <= 0), 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), share))).cast("bigint")


def status_label(status: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in STATUS_LABELS.items() for x in kv))
    return F.coalesce(labels[status], F.nullif(status, F.lit("")), F.lit(UNKNOWN))


def is_final(status: Column) -> Column:
    return F.coalesce(status.isin(*FINAL), F.lit(False))


def of_book(book: Column, wanted: Column) -> Column:
    """Of the book, or of none in particular."""
    return wanted.isNull() | book.isNull() | (book == wanted)
