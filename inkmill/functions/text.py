"""Native text expressions: trimming, canonical form, upload checks, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "\\p{IsWhite_Space}"


def utrim(c: Column) -> Column:
    """Trims Unicode white space at both ends (trim() knows U+0020 alone)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def blank(c: Column) -> Column:
    return ~c.rlike(f"\\P{{IsWhite_Space}}")


def collapse_ws(c: Column) -> Column:
    """Each run of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def code_text(c: Column) -> Column:
    """CR and CRLF to LF, and one newline off the end."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n\\z", "")


def canonical(c: Column) -> Column:
    """One leading byte order mark off, then CRLF and lone CR to LF."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n")


def estimate_tokens(c: Column) -> Column:
    """ceil of tenths: white space 0, ASCII letters, digits and punctuation 3, anything else 15."""
    n = F.char_length(c)
    spaces = F.char_length(F.regexp_replace(c, f"\\P{{IsWhite_Space}}", ""))
    light = F.char_length(F.regexp_replace(c, "[^A-Za-z0-9!\"#%&'()*,\\-./:;?@\\[\\\\\\]_{}]", ""))
    return F.ceil((n * 15 - spaces * 15 - light * 12) / 10).cast("int")


def valid_document_key(c: Column) -> Column:
    """1 to 128 code points, once trimmed: letters, decimal digits, full stop, underscore, slash, hyphen."""
    return F.coalesce(utrim(c).rlike("^[\\p{L}\\p{Nd}._/-]{1,128}\\z"), F.lit(False))


def upload_failure(key: Column, file_name: Column, content: Column, max_bytes: Column | int, size: Column | None = None) -> Column:
    """The first rule that an upload breaks, as its code; null for a good one. content: raw bytes; size: theirs, if known apart."""
    text = content.cast("string")
    name = F.coalesce(utrim(file_name), F.lit(""))
    limit = max_bytes if isinstance(max_bytes, Column) else F.lit(max_bytes)
    return (
        F.when(~valid_document_key(key), "INVALID_DOCUMENT_KEY")
        .when(name == "", "FILE_REQUIRED")
        .when(~(F.lower(name).endswith(".md") | F.lower(name).endswith(".markdown")), "UNSUPPORTED_FILE_TYPE")
        .when((F.octet_length(content) if size is None else size) > limit, "FILE_TOO_LARGE")
        .when(~F.is_valid_utf8(text) | (F.instr(text, "\x00") > 0), "INVALID_MARKDOWN_ENCODING")
        .when(F.coalesce(blank(canonical(text)), F.lit(True)), "EMPTY_DOCUMENT")
    )


def normalize_query(c: Column) -> Column:
    """The agent graph's only node: a trimmed query, null where nothing is left."""
    return F.when(~blank(c), utrim(c))
