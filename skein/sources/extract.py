"""Bytes to text: formats, character sets, markup. Plain text without markup never leaves the JVM."""

from __future__ import annotations

import base64
import binascii
import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import squeeze
from skein.settings import CONTENT_LIMIT, Settings

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("warning", T.StringType())])
# Tags that separate words, signs of markup, file names that say so.
BLOCK_TAGS = r"(?i)</?(?:p|div|td|th|li|ul|ol|table|tr|h[1-6]|header|footer|section|article|blockquote|pre|aside|nav|main|figure|figcaption|br|hr)\b[^>]*>"
MARKUP_START = r"(?is)^\x{FEFF}?\s*<(?:!doctype|html|\?xml|svg)"
MARKUP_INSIDE = r"(?i)</(?:p|div|span|a|li|td)\s*>|<br\s*/?>"
MARKUP_NAME = r"(?i)\.(?:html|htm|xhtml|xml|svg)\z"
_BLOCK = re.compile(BLOCK_TAGS)
_SPACE = re.compile(r"\s+")
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
SNIFF_BYTES = 8192


def cut_bytes(text: Column, limit: Column) -> Column:
    """The longest start of whole characters within so many bytes."""
    raw = F.substring(F.encode(text, "UTF-8"), F.lit(1), limit)
    # A cut character leaves at most three bytes that are not valid.
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), limit - k).cast("string")) for k in range(4)], F.lit(""))
    return F.when(F.octet_length(text) <= limit, text).when(limit <= 0, F.lit("")).otherwise(whole)


def looks_like_markup(text: Column, title: Column, unencoded: bool) -> Column:
    out = text.rlike(MARKUP_START) | F.coalesce(title, F.lit("")).rlike(MARKUP_NAME)
    return out | text.rlike(MARKUP_INSIDE) if unencoded else out


def looks_like_markup_text(text: str, title: str) -> bool:
    return bool(re.match(r"(?is)﻿?\s*<(?:!doctype|html|\?xml|svg)", text) or re.search(r"(?i)\.(?:html|htm|xhtml|xml|svg)\Z", title))


def strip_tags(text: str) -> str:
    """Text outside tags, comments and declarations; a bracket before white space is text; quotes hide closing brackets."""
    out, i, n = [], 0, len(text)
    while i < n:
        at = text.find("<", i)
        if at < 0:
            out.append(text[i:])
            break
        out.append(text[i:at])
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            i = n if end < 0 else end + 3
            continue
        if at + 1 < n and text[at + 1].isspace():
            out.append("<")
            i = at + 1
            continue
        quote, j = "", at + 1
        while j < n:
            c = text[j]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and j > at + 1:
                quote = c
            elif c == ">":
                break
            j += 1
        i = j + 1
    return "".join(out)


def strip_markup(text: str) -> str:
    if "<" in text:
        text = strip_tags(_BLOCK.sub(" ", text))
    return html.unescape(text) if "&" in text else text


def clean_text(text: str, markup: bool, cap: int | None) -> str:
    text = text.replace("\0", " ")
    if markup:
        text = strip_markup(text)
    text = _SPACE.sub(" ", text).strip()
    if cap is None:
        return text
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= cap else raw[:cap].decode("utf-8", "ignore")


def to_text(raw: bytes) -> str:
    """UTF-16 and UTF-8 by their marks, UTF-8, lightly damaged UTF-8, else the Turkish Windows code page."""
    if raw.startswith(b"\xef\xbb\xbf"):
        raw = raw[3:]
    elif raw.startswith(b"\xff\xfe"):
        return raw[2:].decode("utf-16-le", "replace")
    elif raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        damaged = raw.decode("utf-8", "replace")
        bad = damaged.count("�")
        good = sum(ord(c) >= 0x80 for c in damaged) - bad
        return damaged.replace("�", "") if good >= 2 * bad else raw.decode("cp1254", "replace").replace("�", "")


def looks_like_text(raw: bytes) -> bool:
    head = raw[:SNIFF_BYTES]
    if b"\0" in head:
        return head.startswith((b"\xff\xfe", b"\xfe\xff"))
    for cut in range(4):
        try:
            head[: len(head) - cut].decode()
            return True
        except UnicodeDecodeError:
            continue
    controls = sum(b < 32 and b not in (9, 10, 12, 13) for b in head)
    printable = sum(32 <= b < 127 for b in head)
    return controls < 0.02 * len(head) and printable >= 0.15 * len(head)


def extract_bytes(raw: bytes, title: str, settings: Settings) -> tuple[str, str]:
    """(text, warning) of a file's bytes."""
    from skein.sources import office, tools

    cap = settings.max_content_size
    if cap == 0:
        return "", ""
    if raw.startswith(b"%PDF-"):
        text, warning = tools.pdf(raw, settings)
    elif raw.startswith(b"PK\x03\x04"):
        found = office.read(raw, cap)
        if found is None:
            return "", "archive in an unsupported format, indexed without content"
        text, warning = found
    elif raw.startswith(OLE):
        text, warning = tools.legacy_office(raw, settings)
    elif looks_like_text(raw):
        text = to_text(raw)
        return clean_text(text, looks_like_markup_text(text, title), cap), ""
    else:
        return "", "binary content in an unsupported format, indexed without content"
    return clean_text(text, False, cap), warning


def _stripped(cap: int | None):
    # Texts come whole and may be long, so not by Arrow, which hands over 10,000 rows at once, but 100 rows at a time.
    @F.udf(T.StringType(), useArrow=False)
    def stripped(text: str | None) -> str | None:
        return None if text is None else clean_text(text, True, cap)

    return stripped


def extracted(content: Column, encoded: Column, title: Column, settings: Settings) -> Column:
    """struct(text, warning). Only base64 and markup go through Python."""
    cap = settings.max_content_size
    if cap == 0:
        return F.struct(F.lit("").alias("text"), F.lit("").alias("warning"))

    @F.udf(RESULT, useArrow=False)
    def decoded(content: str | None, title: str | None) -> tuple[str, str]:
        if not content:
            return "", ""
        try:
            raw = base64.b64decode(content, validate=True)
        except (binascii.Error, ValueError):
            return "", "content is not valid base64"
        try:
            return extract_bytes(raw, title or "", settings)
        except Exception as e:  # one broken file must not fail its batch
            return "", f"content could not be read: {type(e).__name__}"

    stripped = _stripped(cap)

    text = F.coalesce(content, F.lit(""))
    markup = looks_like_markup(text, title, True)
    plain = cut_bytes(squeeze(F.translate(text, "\0", " ")), F.lit(cap))
    from_bytes = decoded(F.when(encoded, text), title)
    from_markup = stripped(F.when(~encoded & markup, text))
    return F.when(encoded, from_bytes).otherwise(F.struct(F.when(markup, from_markup).otherwise(plain).alias("text"), F.lit("").alias("warning")))


def page_text(page: Column, cap: int | None = CONTENT_LIMIT) -> Column:
    """Text of an HTML page, all of it without a cap."""
    return _stripped(cap)(page)
