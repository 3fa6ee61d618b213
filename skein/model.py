"""Schemas and request objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

#: What build.index_rows() takes. ``encoded`` says that content is base64; ``status`` holds the flags below.
INCOMING = (
    "provider_id string, document_id string, owner string, users array<string>, groups array<string>, circles array<string>, links array<string>, "
    "title string, content string, encoded boolean, tags array<string>, metatags array<string>, subtags map<string,array<string>>, source string, "
    "modified_time bigint, parts map<string,string>, info string, status int"
)
#: One row for each document of an index.
DOCUMENT = (
    "id bigint, provider_id string, document_id string, owner_id string, access array<string>, links array<string>, tags array<string>, metatags array<string>, "
    "subtags array<string>, subtags_map map<string,array<string>>, source string, hash string, modified_time bigint, indexed_at bigint, config string, title string, "
    "tags_text string, parts map<string,string>, parts_text string, content string, info string, title_search string, warning string"
)
#: One row for each lexeme and weight of a document; positions are shared by all fields of the document.
POSTING = "lexeme string, config string, id bigint, weight string, positions array<int>"
#: One row for each surface word and weight of a document, unstemmed.
SURFACE = "word string, config string, id bigint, weight string"
WORD = "word string, folded string"

#: Status flags of an incoming document: which parts of a stored one it replaces. None of the last four means all.
FULL, META, CONTENT, PARTS, OK = 28, 4, 8, 16, 1
#: Field names of a limited search, and the weights that they are indexed with.
FIELD_WEIGHTS = {"title": "A", "tags": "B", "parts": "C", "content": "D"}
WEIGHT_VALUES = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

TEXT, KEYWORD, ARRAY, INT_EQ, INT_GTE, INT_GT, INT_LTE, INT_LT, BOOL, WILDCARD, REGEX = "text", "keyword", "array", "int_eq", "int_gte", "int_gt", "int_lte", "int_lt", "bool", "wildcard", "regex"


@dataclass(frozen=True)
class SimpleQuery:
    """One typed condition on a column, a part (``parts.x``) or an info key (``info.x`` or a bare name)."""

    kind: str
    field: str
    values: Sequence[object] = ()


@dataclass(frozen=True)
class SearchRequest:
    """A search. Groups of wildcard and regex entries are lists of (field, pattern): entries OR, groups AND."""

    search: str = ""
    page: int = 1
    size: int = 20
    provider: str = ""
    metatags: Sequence[str] = ()
    subtags: Sequence[str] = ()
    since: int = 0
    until: int = 0
    empty_search: bool = False
    wildcards: Sequence[Sequence[tuple[str, str]]] = ()
    regexes: Sequence[Sequence[tuple[str, str]]] = ()
    limit_fields: Sequence[str] = ()
    simple: Sequence[SimpleQuery] = ()
    #: Accepted and ignored.
    fields: Sequence[str] = ()
    parts: Sequence[str] = ()
    wildcard_fields: Sequence[str] = ()


@dataclass
class SearchResult:
    documents: list[dict] = field(default_factory=list)
    total: int = 0
    max_score: int = 0
    time_ms: int = 0
    timed_out: bool = False
    #: Words that were searched besides each typed one.
    alternatives: Mapping[str, Sequence[str]] = field(default_factory=dict)
