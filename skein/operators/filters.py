"""Filters over index rows: access, tags, dates, patterns, and typed conditions. What is not valid matches nothing."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.access import usable
from skein.functions.analyzer import lexeme
from skein.functions.patterns import regex_filter, wildcard_filter
from skein.functions.text import tokens, tokens_text
from skein.model import ARRAY, BOOL, FIELD_WEIGHTS, INT_EQ, INT_GT, INT_GTE, INT_LT, INT_LTE, KEYWORD, REGEX, TEXT, WILDCARD, SearchRequest, SimpleQuery
from skein.operators.match import all_of, any_of, in_language, limited

# Names by which typed conditions reach columns, and names that never mean an info key.
STRING_COLUMNS = {"title": "title", "content": "content", "source": "source", "hash": "hash", "owner": "owner_id", "owner_id": "owner_id", "provider": "provider_id", "provider_id": "provider_id", "document_id": "document_id"}
ARRAY_COLUMNS = {"tags": "tags", "metatags": "metatags", "subtags": "subtags", "links": "links"}
INT_COLUMNS = {"modified_time": "modified_time", "lastModified": "modified_time"}
RESERVED = {"id", "indexed_at", "config", "access", "users", "groups", "circles", "tsv", "title_search", "tags_text", "parts_text", "parts", "info", "subtags_map", "combined", "more"}

#: Fields with lexemes of their own: a TEXT condition on them is a search limited to the field.
INDEXED_TEXT = ("title", "tags", "content")

_INTEGER = re.compile(r"[+-]?[0-9]{1,64}")
_BIG = 10**37


def never() -> Column:
    return F.lit(False)


def visible(tokens_: Sequence[str]) -> Column:
    """Documents that share a token with the viewer; none for a viewer without tokens."""
    return F.arrays_overlap("access", F.array(*map(F.lit, tokens_))) if tokens_ else never()


def any_tag(column: str, tags: Sequence[str]) -> Column:
    own = [t for t in tags if usable(t)]
    return F.arrays_overlap(column, F.array(*map(F.lit, own))) if own else never()


def all_tags(column: str, tags: Sequence[str]) -> Column:
    if not all(usable(t) for t in tags):
        return never()
    return all_of([F.array_contains(column, t) for t in dict.fromkeys(tags)])


def date_range(since: int, until: int) -> Column:
    """Inclusive bounds; 0 and less are no bounds."""
    out = F.lit(True)
    if since > 0:
        out = out & (F.col("modified_time") >= since)
    if until > 0:
        out = out & (F.col("modified_time") <= until)
    return out


def pattern_group(group: Sequence[tuple[str, str]], is_regex: bool) -> Column:
    """Any entry of a group; entries on other fields than title and content, or without a usable pattern, drop out."""
    make = regex_filter if is_regex else wildcard_filter
    found = [F.col(f).rlike(p) for f, p in ((f, make(p)) for f, p in group if f in ("title", "content")) if p]
    return any_of(found)


def _flat(values: Sequence[object]) -> list[object]:
    return [y for x in values for y in (x if isinstance(x, (list, tuple)) else [x])]


def _as_string(value: object) -> str | None:
    if isinstance(value, bool) or not isinstance(value, (str, int)):
        return None
    text = str(value)
    return text if text == "" or usable(text) else None


def _as_integer(value: object) -> int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value
    return int(value) if isinstance(value, str) and _INTEGER.fullmatch(value) else None


def _info(key: str) -> Column:
    """The value of an info key as a variant; null where info is absent or no JSON object has it."""
    return F.try_variant_get(F.try_parse_json("info"), "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text_condition(text: Column, words: str, languages: Sequence[str]) -> Column:
    """All words, stemmed, in any order; nothing for stop words alone. Stems of the text are taken in its row's language."""
    from skein.functions.analyzer import stems

    own = stems(tokens(text), F.col("config"), list(languages))
    branches = []
    for language in languages:
        wanted = list(dict.fromkeys(x for t in tokens_text(words) if (x := lexeme(t, language))))
        if wanted:
            branches.append(in_language(F.col("config"), language, languages) & (F.size(F.array_except(F.array(*map(F.lit, wanted)), own)) == 0))
    return text.isNotNull() & any_of(branches)


def _compare(kind: str, column: Column, value: int) -> Column:
    if abs(value) > _BIG:  # no stored number is beyond it, so the sign decides
        return F.lit((kind in (INT_LTE, INT_LT)) if value > 0 else (kind in (INT_GTE, INT_GT))) & column.isNotNull()
    bound = F.lit(str(value)).cast("decimal(38,0)")
    return {INT_EQ: column == bound, INT_GTE: column >= bound, INT_GT: column > bound, INT_LTE: column <= bound, INT_LT: column < bound}[kind]


def simple(query: SimpleQuery, languages: Sequence[str]) -> Column:
    """One typed condition. Types that do not go with the field, reserved names and unusable values match nothing.

    Not for TEXT on INDEXED_TEXT, which needs postings: see rows_of_request().
    """
    name, kind = query.field, query.kind
    part = name[6:] if name.startswith("parts.") else None
    key = name[5:] if name.startswith("info.") else None
    string, array, number = STRING_COLUMNS.get(name), ARRAY_COLUMNS.get(name), INT_COLUMNS.get(name)
    if part is None and key is None and not (string or array or number):
        if name in RESERVED or name.startswith("_") or not usable(name):
            return never()
        key = name
    if (part is not None and not usable(part)) or (key is not None and not usable(key)):
        return never()
    values = _flat(query.values) if kind in (KEYWORD, ARRAY) else list(query.values[:1])
    info = _info(key) if key is not None else None
    info_string = F.when(_kind(info) == "STRING", F.try_variant_get(info, "$", "string")) if info is not None else None
    text = F.col(string) if string else F.element_at("parts", part) if part is not None else info_string
    if kind == TEXT:
        if not values or not isinstance(values[0], str) or not values[0].strip():
            return never()
        if number:
            return never()
        return _text_condition(F.array_join(array, " ") if array else text, values[0], languages)
    if kind in (KEYWORD, ARRAY):
        own = [x for x in map(_as_string, values) if x is not None]
        if not own:
            return never()
        if number:
            whole = [x for x in map(_as_integer, values) if x is not None and -(1 << 63) <= x < 1 << 63]
            return F.col(number).isin(whole) if whole else never()
        if array:
            return F.arrays_overlap(array, F.array(*map(F.lit, own)))
        if info is not None:
            elements = F.from_json(F.when(F.startswith(_kind(info), F.lit("ARRAY")), F.to_json(info)), "array<string>")
            return F.coalesce(info_string.isin(own), F.lit(False)) | F.coalesce(F.arrays_overlap(elements, F.array(*map(F.lit, own))), F.lit(False))
        return F.coalesce(text.isin(own), F.lit(False))
    if kind in (INT_EQ, INT_GTE, INT_GT, INT_LTE, INT_LT):
        value = _as_integer(values[0]) if values else None
        if value is None:
            return never()
        if number:
            return _compare(kind, F.col(number), value)
        if info is not None:
            is_number = _kind(info).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
            return F.coalesce(_compare(kind, F.when(is_number, F.try_variant_get(info, "$", "decimal(38,9)")), value), F.lit(False))
        return never()
    if kind == BOOL:
        value = {True: True, False: False, "true": True, "false": False}.get(values[0]) if values and isinstance(values[0], (bool, str)) else None
        if info is None or value is None:
            return never()
        return F.coalesce((_kind(info) == "BOOLEAN") & (F.try_variant_get(info, "$", "boolean") == value), F.lit(False))
    if kind in (WILDCARD, REGEX):
        pattern = (regex_filter if kind == REGEX else wildcard_filter)(values[0]) if values else None
        if pattern is None or number:
            return never()
        if array:
            return F.exists(array, lambda x: x.rlike(pattern))
        return F.coalesce(text.rlike(pattern), F.lit(False))
    return never()


def weights(fields: Sequence[str]) -> list[str]:
    """Weights that a search is limited to; all without a limit, none if only unknown fields are named."""
    if not fields:
        return list(FIELD_WEIGHTS.values())
    return list(dict.fromkeys(FIELD_WEIGHTS["parts" if f.startswith("parts.") else f] for f in fields if f in FIELD_WEIGHTS or f.startswith("parts.")))


def of_request(request: SearchRequest, tokens_: Sequence[str], languages: Sequence[str]) -> Column:
    """All conditions of a request but the words."""
    out = [F.col("provider_id") == request.provider, visible(tokens_), date_range(request.since, request.until)]
    if request.metatags:
        out.append(any_tag("metatags", request.metatags))
    if request.subtags:
        out.append(all_tags("subtags", request.subtags))
    out += [pattern_group(g, False) for g in request.wildcards] + [pattern_group(g, True) for g in request.regexes]
    out += [simple(q, languages) for q in request.simple if not _is_search(q)]
    return all_of(out)


def _is_search(query: SimpleQuery) -> bool:
    return query.kind == TEXT and query.field in INDEXED_TEXT


def rows_of_request(docs: DataFrame, postings: DataFrame | Callable[..., DataFrame], request: SearchRequest, tokens_: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """docs that meet all conditions of a request but the words, typed searches of single fields included.

    postings: a table, or what makes them, see limited().
    """
    out = docs.where(of_request(request, tokens_, languages))
    for q in request.simple:
        if _is_search(q):
            text = q.values[0] if q.values and isinstance(q.values[0], str) else ""
            out = limited(out, postings, text, FIELD_WEIGHTS[q.field], languages)
    return out
