"""Settings: every value is checked before any is changed."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from functools import cache

from skein.functions.analyzer import LANGUAGES

MAX_LANGUAGES = 5
CONTENT_LIMIT = 1_000_000
PDF_EXTRACTORS = ("auto", "pdftotext", "pdfparser")
_TRUE, _FALSE = {"1", "true", "on", "yes"}, {"0", "false", "off", "no", ""}


class SettingError(ValueError):
    pass


@cache
def _left_out(names: tuple[str, ...]) -> None:
    logging.getLogger("skein").warning("no analyzer for %s", ", ".join(names))


def _boolean(name: str, value: object) -> bool:
    text = str(value).strip().lower()
    if text in _TRUE:
        return True
    if text in _FALSE:
        return False
    raise SettingError(f"{name} must be true or false")


def _integer(name: str, value: object, low: int, high: int) -> int:
    try:
        n = int(str(value).strip())
    except ValueError:
        raise SettingError(f"{name} must be a whole number") from None
    if not low <= n <= high:
        raise SettingError(f"{name} must lie between {low} and {high}")
    return n


def parse_languages(value: object) -> list[str]:
    """Distinct names, lower-cased, in order; a list or text with commas."""
    names = value if isinstance(value, (list, tuple)) else str(value).split(",")
    return list(dict.fromkeys(n.strip().lower() for n in map(str, names) if n.strip()))


@dataclass(frozen=True)
class Settings:
    """One language, or several of which the first is the fallback; sizes in bytes; timeout in seconds, 0 for none."""

    language: str = "english"
    use_trigram: bool = True
    typo_correction: bool = True
    max_results: int = 100
    max_content_size: int = 512_000
    search_timeout: int = 10
    pdftotext_path: str = ""
    pdf_extractor: str = "auto"

    @property
    def languages(self) -> list[str]:
        """Those that there is an analyzer for; the others are named in the log, once."""
        names = parse_languages(self.language)
        known = [x for x in names if x in LANGUAGES]
        if len(known) < len(names):
            _left_out(tuple(x for x in names if x not in LANGUAGES))
        return known or ["simple"]

    def changed(self, values: Mapping[str, object]) -> tuple[Settings, bool]:
        """(new settings, whether documents must be indexed anew). Unknown names and bad values raise, and nothing changes."""
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise SettingError("unknown settings: " + ", ".join(sorted(unknown)))
        new: dict[str, object] = {}
        for name, value in values.items():
            if name == "language":
                names = parse_languages(value)
                if not names:
                    raise SettingError("language must name at least one language")
                if len(names) > MAX_LANGUAGES:
                    raise SettingError(f"language takes at most {MAX_LANGUAGES} languages")
                if bad := [n for n in names if n not in LANGUAGES]:
                    raise SettingError(f"no such language: {', '.join(bad)}; there are {', '.join(LANGUAGES)}")
                new[name] = ",".join(names)
            elif name in ("use_trigram", "typo_correction"):
                new[name] = _boolean(name, value)
            elif name == "max_results":
                new[name] = _integer(name, value, 1, 10_000)
            elif name == "max_content_size":
                new[name] = _integer(name, value, 0, CONTENT_LIMIT)
            elif name == "search_timeout":
                new[name] = _integer(name, value, 0, 300)
            elif name == "pdf_extractor":
                if value not in PDF_EXTRACTORS:
                    raise SettingError(f"pdf_extractor must be one of {', '.join(PDF_EXTRACTORS)}")
                new[name] = value
            elif name == "pdftotext_path":
                new[name] = _tool_path(str(value).strip())
        out = replace(self, **new)
        return out, out.languages[:1] != self.languages[:1] or set(out.languages[1:]) != set(self.languages[1:])

    def clamped(self) -> Settings:
        """Stored values that are out of range, brought back into it."""
        return replace(
            self, max_results=min(10_000, max(1, self.max_results)), max_content_size=min(CONTENT_LIMIT, max(0, self.max_content_size)),
            search_timeout=min(300, max(0, self.search_timeout)), pdf_extractor=self.pdf_extractor if self.pdf_extractor in PDF_EXTRACTORS else "auto",
        )


def _tool_path(path: str) -> str:
    """Only an executable called pdftotext is ever run; empty means that PATH is searched."""
    if path and (os.path.basename(path) not in ("pdftotext", "pdftotext.exe") or not os.path.isabs(path) or not os.access(path, os.X_OK)):
        raise SettingError("pdftotext_path must be the absolute path of an executable called pdftotext")
    return path
