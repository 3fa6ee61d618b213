"""Text of ODF and OOXML files, by a table of rules for each kind of entry."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

from skein.functions.text import natural_key

MAX_ENTRY, MAX_TOTAL, MAX_ENTRIES = 32 << 20, 128 << 20, 2000


@dataclass(frozen=True)
class Rules:
    """Element names: where text counts (None: everywhere), whose end or start separates words, which stand for a space, which are left out."""

    text: frozenset[str] | None = None
    breaks: frozenset[str] = frozenset()
    start_breaks: frozenset[str] = frozenset()
    spaces: frozenset[str] = frozenset()
    skip: frozenset[str] = frozenset()
    attributes: dict[str, str] = field(default_factory=dict)
    cells: bool = False


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Fixed values of the file formats: entries in reading order, and their element names.
_ODF_BREAKS = "p h line-break table-cell list-item note-citation annotation annotation-end note"
_ODF_EDGES = "header header-left header-first footer footer-left footer-first"
_WORD = Rules(_names("t"), _names("p br cr tc"), spaces=_names("tab ptab"), skip=_names("Fallback"))
_DRAWING = Rules(_names("t"), _names("p br tc"), skip=_names("Fallback"))
FORMATS: dict[str, list[tuple[str, Rules]]] = {
    "odf": [
        (r"content\.xml", Rules(None, _names(_ODF_BREAKS), _names("annotation note"), _names("s tab"), _names("tracked-changes creator date sequence-decls automatic-styles font-face-decls"))),
        (r"styles\.xml", Rules(_names(_ODF_EDGES), _names(_ODF_BREAKS + " " + _ODF_EDGES), _names("annotation note"), _names("s tab"), _names("tracked-changes creator date styles automatic-styles font-face-decls"))),
    ],
    "docx": [(r"word/document\d*\.xml", _WORD), (r"word/(footnotes|endnotes)\.xml", _WORD), (r"word/(header|footer)\d*\.xml", _WORD), (r"word/comments(Extended)?\.xml", _WORD), (r"word/diagrams/data\d+\.xml", _DRAWING)],
    "xlsx": [
        (r"xl/sharedStrings\.xml", Rules(_names("t"), _names("si"), skip=_names("rPh phoneticPr"))),
        (r"xl/workbook\.xml", Rules(frozenset(), attributes={"sheet": "name"})),
        (r"xl/worksheets/sheet\d+\.xml", Rules(_names("v t"), _names("c"), skip=_names("f rPh"), cells=True)),
        (r"xl/comments\d*\.xml", Rules(_names("t"), _names("comment si"), skip=_names("authors"))),
        (r"xl/threadedComments/threadedComment\d*\.xml", Rules(_names("text"), _names("threadedComment"))),
        (r"xl/drawings/drawing\d+\.xml", _DRAWING),
        (r"xl/diagrams/data\d+\.xml", _DRAWING),
    ],
    "pptx": [
        (r"ppt/slides/slide\d+\.xml", _DRAWING),
        (r"ppt/notesSlides/notesSlide\d+\.xml", _DRAWING),
        (r"ppt/diagrams/data\d+\.xml", _DRAWING),
        (r"ppt/comments/(comment|modernComment_)[^/]*\.xml", Rules(_names("text t"), _names("cm p"))),
    ],
}
#: Cell types whose value is no text: an index into shared strings, a truth value, an error.
_NO_TEXT = {"s", "b", "e"}


def _format(names: list[str]) -> str | None:
    for kind, entry in (("docx", "word/document"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml")):
        if any(n.startswith(entry) for n in names):
            return kind
    return "odf" if "content.xml" in names else None


def xml_text(raw: bytes, rules: Rules) -> str:
    """Text of one entry, up to the point where it is malformed."""
    out: list[str] = []
    state = {"skip": 0, "text": 0, "mute": 0}
    local = lambda name: name.rpartition(":")[2]

    def start(name: str, attributes: dict[str, str]) -> None:
        name = local(name)
        if state["skip"] or name in rules.skip:
            state["skip"] += 1
            return
        if name in rules.start_breaks or name in rules.spaces:
            out.append(" ")
        if name in rules.attributes:
            out.extend((" ", next((v for k, v in attributes.items() if local(k) == rules.attributes[name]), ""), " "))
        if rules.cells and name == "c":
            state["mute"] = attributes.get("t") in _NO_TEXT
        if rules.text is not None and name in rules.text and not (state["mute"] and name == "v"):
            state["text"] += 1

    def end(name: str) -> None:
        name = local(name)
        if state["skip"]:
            state["skip"] -= 1
            return
        if rules.text is not None and name in rules.text and not (state["mute"] and name == "v"):
            state["text"] -= 1
        if name in rules.breaks:
            out.append(" ")
        if rules.cells and name == "c":
            state["mute"] = 0

    def data(text: str) -> None:
        if not state["skip"] and (rules.text is None or state["text"] > 0):
            out.append(text)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(raw, True)
    except expat.ExpatError:
        pass
    return "".join(out)


def _entries(archive: zipfile.ZipFile, kind: str) -> Iterator[tuple[zipfile.ZipInfo, Rules]]:
    infos = {i.filename: i for i in archive.infolist()}
    for pattern, rules in FORMATS[kind]:
        for name in sorted((n for n in infos if re.fullmatch(pattern, n)), key=natural_key):
            yield infos[name], rules


def read(raw: bytes, budget: int) -> tuple[str, str] | None:
    """(text, warning); None for an archive that is no office file. Budgets hold for bytes of text, entries, and unpacked bytes."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
        kind = _format(archive.namelist())
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return "", "archive is damaged, indexed without content"
    if kind is None:
        return None
    parts: list[str] = []
    size = total = 0
    warning = ""
    for n, (info, rules) in enumerate(_entries(archive, kind)):
        if n >= MAX_ENTRIES or total >= MAX_TOTAL:
            warning = "office file is too large, indexed in part"
            break
        try:
            with archive.open(info) as f:
                unpacked = f.read(min(MAX_ENTRY, MAX_TOTAL - total) + 1)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError, ValueError):
            warning = "office file is damaged, indexed in part"
            continue
        if len(unpacked) > min(MAX_ENTRY, MAX_TOTAL - total):
            unpacked, warning = unpacked[:-1], "office file is too large, indexed in part"
        total += len(unpacked)
        text = xml_text(unpacked, rules)
        parts.append(text)
        size += len(text.encode("utf-8", "replace"))
        if size > budget:
            break
    return " ".join(parts), warning
