"""Text functions as Column expressions.

White space and line ends follow the Unicode rules of ``str.strip`` and
``str.splitlines``, which neither Java's ``\\s`` nor ``trim`` does; the classes
below list every member, so that the same class works in any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of the Unicode white-space class, as ranges of code points.
WS_RANGES = ((0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _members(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


#: Inside of a character class, for Java and RE2 alike.
WS = _members(WS_RANGES)
WS_CHARS = "".join(chr(c) for a, b in WS_RANGES for c in range(a, b + 1))
#: Line ends but CR, which may be the first half of one.
_BREAKS = _members(((0xA, 0xC), (0x1C, 0x1E), (0x85, 0x85), (0x2028, 0x2029)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.  Expressions repeated inside
    of lambda functions are computed each time; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without outer white space; only the ends are looked at, however much white
    space lies inside."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def blank_to_null(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def unix_lines(c: Column | str) -> Column:
    """CRLF and CR as LF."""
    return F.replace(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines_with_ends(c: Column | str) -> Column:
    """Array of lines, each with its end (a trailing empty piece may follow)."""
    return F.split(_col(c), rf"(?<=[{_BREAKS}])|(?<=\r)(?!\n)")


def char_count(c: Column | str) -> Column:
    """Characters that aren't white space."""
    return F.length(F.translate(_col(c), WS_CHARS, "")).cast("bigint")


def paragraph_count(c: Column | str) -> Column:
    """Pieces between blank lines that aren't blank."""
    pieces = F.split(strip(c), rf"\n[{WS}]*\n")
    return F.size(F.filter(pieces, lambda p: strip(p) != "")).cast("bigint")


def first_line(c: Column | str) -> Column:
    """First line that isn't blank, stripped; NULL if there is none."""
    kept = F.filter(F.transform(lines_with_ends(c), strip), lambda s: s != "")
    return F.get(kept, F.lit(0))


def one_spaced(c: Column | str) -> Column:
    """Every run of white space as one blank, outer ones dropped."""
    return strip(F.regexp_replace(_col(c), rf"[{WS}]+", " "))


def shortened(c: Column | str, limit: int) -> Column:
    """``one_spaced`` and at most ``limit`` characters, cut marked by dots."""
    return let(one_spaced(c), lambda s: F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 3)), F.lit("..."))).otherwise(s))


def html_escaped(c: Column | str) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def prompt_parts(*parts: Column | str, sep: str = "\n\n") -> Column:
    """Parts that aren't blank, stripped and joined."""
    return F.concat_ws(sep, *(blank_to_null(p) for p in parts))


def filled_template(template: Column | str, text: Column | str) -> Column:
    """``{source_text}`` of a template filled in; NULL where the template has
    stray braces, which makes it invalid."""
    t = _col(template)
    doubled = F.regexp_replace(t, r"\{\{|\}\}|\{source_text\}", "")
    filled = F.replace(t, F.lit("{source_text}"), _col(text))
    plain = F.replace(F.replace(filled, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    return F.when(~doubled.contains("{") & ~doubled.contains("}"), F.when(t.contains("{{") | t.contains("}}"), plain).otherwise(filled))
