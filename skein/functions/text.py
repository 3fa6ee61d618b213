"""Case, accents, titles, tokens: as Column expressions, so that they stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Each letter of the first line folds to the letter below it.
FOLD_FROM = "çğıöşüâîûéèêëáàäãåāóòôõōøőúùūñýÿíìïīčšžřďťňęąłżźćń"
FOLD_TO = "cgiosuaiueeeeaaaaaaooooooouuunyyiiiicszrdtnealzzcn"

#: Word characters of every analyzer.
WORD = r"[\p{L}\p{N}]"
#: One token: e-mail address, host with an optional path, hyphenated compound, or run of letters and digits.
TOKEN = (
    r"[\p{L}\p{N}][\p{L}\p{N}._+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
    r"|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*(?:\.[\p{L}\p{N}-]*\p{L}[\p{L}\p{N}-]*)+(?:/[\p{L}\p{N}/._~%+-]*[\p{L}\p{N}/])?"
    r"|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+"
    r"|[\p{L}\p{N}]+"
)
_TOKEN = regex.compile(TOKEN)
# Java only: a whole run that nothing follows which could make it an address, a host or a compound needs no other try.
_TOKEN_JAVA = r"[\p{L}\p{N}]++(?![@._+-])|" + TOKEN
_SPLITS = (
    (r"(\p{L})(\p{N})", "$1 $2"),
    (r"(\p{N})(\p{L})", "$1 $2"),
    (r"[_.\-/\\+~,;:()\[\]{}]+", " "),
)


def lower(text: Column) -> Column:
    """Lower case in which a dotted capital I becomes a plain i, not two code points."""
    return F.lower(F.translate(F.replace(text, F.lit("i̇"), F.lit("i")), "İ", "i"))


def lower_text(text: str) -> str:
    return text.replace("i̇", "i").replace("İ", "i").lower()


def turkish(text: Column, config: Column) -> Column:
    """Map I and İ to their Turkish small letters in rows of that language."""
    return F.when(config == "turkish", F.translate(text, "Iİ", "ıi")).otherwise(text)


def fold(text: Column) -> Column:
    """Accents off, letter by letter."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(FOLD_FROM, FOLD_TO))


def split_title(title: Column) -> Column:
    """A title with spaces between letters and digits and in place of punctuation runs."""
    for pattern, to in _SPLITS:
        title = F.regexp_replace(title, pattern, to)
    return title


def split_title_text(title: str) -> str:
    for pattern, to in _SPLITS:
        title = regex.sub(pattern, to.replace("$1", r"\1").replace("$2", r"\2"), title)
    return title


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; a compound is followed by its parts and a host with a path by the host."""
    found = F.regexp_extract_all(lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN_JAVA), F.lit(0))
    return F.flatten(F.transform(found, _with_parts))


def _with_parts(token: Column) -> Column:
    marked = token.contains("@") | token.contains("/") | token.contains(".")
    return (
        F.when(~(marked | token.contains("-")), F.array(token))
        .when(~marked, F.concat(F.array(token), F.split(token, "-")))
        .when(token.contains("/") & ~token.contains("@"), F.array(token, F.substring_index(token, "/", 1)))
        .otherwise(F.array(token))
    )


def tokens_text(text: str) -> list[str]:
    out: list[str] = []
    for t in _TOKEN.findall(lower_text(text)):
        out.append(t)
        if "@" in t:
            continue
        if "/" in t:
            out.append(t.split("/")[0])
        elif "-" in t and "." not in t:
            out.extend(t.split("-"))
    return out


def simple_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, without classes or parts."""
    return F.regexp_extract_all(lower(F.coalesce(text, F.lit(""))), F.lit(WORD + "+"), F.lit(0))


def is_vocabulary_word(word: Column) -> Column:
    return word.rlike(r"^\p{L}{3,40}$")


def valid_word(word: str) -> bool:
    return regex.fullmatch(r"\p{L}{3,40}", word) is not None


def printable(text: str) -> str:
    """Query text without control characters other than tab and line ends, which separate."""
    return "".join(c for c in text if c in "\t\r\n" or unicodedata.category(c) != "Cc")


def squeeze(text: Column) -> Column:
    """Runs of white space, Unicode's included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def natural_key(name: str) -> list:
    """Sort key in which numbers in names count as numbers."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", name)]
