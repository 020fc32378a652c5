"""Text expressions: tokens, truncation, markers, fences. All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orefall import config
from orefall.functions.scores import lowered


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits, ``_``, ``.``, ``@`` and common CJK ideographs."""
    parts = F.split(text, "[^a-zA-Z0-9_.@\\u4e00-\\u9fa5]+")
    return F.transform(F.filter(parts, lambda t: t != ""), F.lower)


def embed_text(text: Column, most: int = 8000) -> Column:
    """Newlines as blanks, trimmed, cut."""
    return F.substring(F.trim(F.translate(text, "\n", " ")), 1, most)


def safe_truncate(text: Column, most: int, suffix: str = config.TRUNCATED) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def smart_truncate(text: Column, most: int | Column, keep: float = 0.7) -> Column:
    """Head and tail around a mark, ``most`` code points in all; shorter texts stay."""
    most = F.lit(most) if isinstance(most, int) else most
    room = most - len(config.ELLIPSIS)
    head = F.floor(room * keep).cast("int")
    tail = F.expr("0") + room - head
    cut = F.concat(F.left(text, head), F.lit(config.ELLIPSIS), F.right(text, tail.cast("int")))
    return F.when(F.length(text) <= most, text).when(room <= 0, F.left(text, most)).otherwise(cut)


def normalize_query(text: Column) -> Column:
    """Trimmed, lower-cased, white space runs as one blank (Unicode white space)."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "(?U)\\s+", " "), "^ | $", ""))


def trimmed(text: Column) -> Column:
    """Without blanks of any script at both ends, as the SQL engine trims."""
    return F.regexp_replace(text, "^\\p{Zs}+|\\p{Zs}+\\z", "")


def is_chatty(query: Column, least: int = 5) -> Column:
    q = lowered(trimmed(query))
    talk = any_of(*[(q == p) | q.startswith(p + " ") for p in config.CHATTY])
    return query.isNull() | (query == "") | (F.length(q) < least) | talk


def shows_code(text: Column) -> Column:
    return F.coalesce(any_of(*[text.contains(m) for m in config.CODE_MARKS]), F.lit(False))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u4e00-\\u9fff]"), F.lit(False))


def strip_fences(text: Column) -> Column:
    """Text without a leading Markdown fence (with or without ``json``) and a closing one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```(?:json)?\\s*", ""), "\\s*```$", ""))


def json_list(text: Column) -> Column:
    """The JSON list of strings in a reply, bare, fenced or between the first ``[`` and the last ``]``; else empty."""
    inner = F.regexp_extract(text, "(?s)\\[.*\\]", 0)
    return F.coalesce(F.from_json(strip_fences(text), "array<string>"), F.from_json(inner, "array<string>"), F.array().cast("array<string>"))


def tool_paths(text: Column) -> Column:
    """Arguments of ``<tool_code>`` tags without quotes and backticks."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)<tool_code>(.*?)</tool_code>"), F.lit(1)), lambda t: F.trim(F.translate(t, "\"'`", "")))


def code_blocks(text: Column) -> Column:
    """Bodies of fenced code blocks."""
    return F.regexp_extract_all(text, F.lit("(?s)```\\w*\\n(.*?)\\n```"), F.lit(1))


def claim_tokens(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z0-9_]+|[\\u4e00-\\u9fff]{1,8})"), F.lit(1)), F.lower)
    stop = F.array(*map(F.lit, config.CLAIM_STOP))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def code_paths(text: Column) -> Column:
    """Source paths in a line; the shorter extension wins where one begins another, as leftmost-first alternation does."""
    return F.regexp_extract_all(text, F.lit(config.CODE_PATH), F.lit(1))


def error_reason(text: Column, fallback: str = "unknown", most: int = 120) -> Column:
    t = F.trim(text)
    return F.substring(F.translate(F.when(t.isNull() | (t == ""), fallback).otherwise(t), "\n\r", "  "), 1, most)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def rechunk(text: Column, size: int = 900) -> Column:
    """Consecutive cuts of ``size`` code points."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def page_text(items: Column) -> Column:
    """Text items of a PDF page: joined, blanks before line ends dropped, at most one empty line, trimmed."""
    joined = F.array_join(items, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "[ \\t]+\\n", "\n"), "\n{3,}", "\n\n"))


def blank(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True))


def extension(path: Column) -> Column:
    """From the last dot of the last segment, lower-cased; empty for none and for names that begin with their only dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(F.regexp_replace(name, "^\\.+", ""), "(\\.[^.]*)$", 1))


def array_literal(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))
