"""Wildcard and regular-expression filters: which patterns count as portable, and how they become Java patterns."""

from __future__ import annotations

import regex

#: Longest accepted pattern, in bytes; greatest repeat; greatest expansion, in atoms.
MAX_BYTES, MAX_REPEAT, MAX_COST = 256, 255, 4096
# Escapes that mean the same everywhere; any escaped punctuation does too.
_LETTER_ESCAPES = frozenset("dDsSwWnrtfae")
_POSIX = {
    "alpha": r"\p{L}", "digit": r"\p{Nd}", "alnum": r"\p{L}\p{N}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"\s",
    "blank": r" \t", "punct": r"\p{P}\p{S}", "cntrl": r"\p{Cc}", "xdigit": "0-9A-Fa-f", "word": r"\p{L}\p{N}_",
}


class Unportable(ValueError):
    """The pattern means different things to different engines, or costs too much."""


class _Reader:
    """Recursive descent over a pattern: checks it, adds up its expansion and writes the Java form."""

    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        got = self.text[self.at : self.at + n]
        self.at += n
        return got

    def alternatives(self, depth: int) -> int:
        """Cost of everything up to the closing parenthesis or the end."""
        if depth > 100:
            raise Unportable("too deep")
        total = self.sequence(depth)
        while self.peek() == "|":
            self.out.append(self.take())
            total += self.sequence(depth)
        return total

    def sequence(self, depth: int) -> int:
        cost = 0
        while self.at < len(self.text) and self.peek() not in ("|", ")"):
            cost += self.quantified(depth)
            if cost > MAX_COST:
                raise Unportable("too large")
        return cost

    def quantified(self, depth: int) -> int:
        cost, lookahead = self.atom(depth)
        while True:
            found = regex.match(r"[*+?]|\{(?:(\d+)(?:,(\d*))?|,(\d+))\}", self.text[self.at :])
            if not found:
                return cost
            if lookahead:
                raise Unportable("repeated lookahead")
            bounds = [x for x in found.groups() if x]
            if any(len(x) > 3 or int(x) > MAX_REPEAT for x in bounds):
                raise Unportable("too many repeats")
            if bounds:
                cost *= max(1, int(bounds[-1]))
            quantifier = self.take(len(found[0]))
            self.out.append("{0," + quantifier[2:] if quantifier.startswith("{,") else quantifier)
            if self.peek() == "+":
                raise Unportable("possessive")
            if self.peek() == "?":
                self.out.append(self.take())

    def atom(self, depth: int) -> tuple[int, bool]:
        c = self.peek()
        if c == "(":
            return self.group(depth)
        if c == "[":
            self.char_class()
        elif c == "\\":
            self.out.append(self.escape())
        elif c == "{":
            self.take()
            self.out.append(r"\{")
        elif c in "]}":
            self.out.append("\\" + self.take())
        else:
            self.out.append(self.take())
        return 1, False

    def group(self, depth: int) -> tuple[int, bool]:
        self.take()
        opening, lookahead = "(", False
        if self.peek() == "*":
            raise Unportable("control verb")
        if self.peek() == "?":
            kind = self.peek(2)[1:]
            if kind not in (":", "=", "!"):
                raise Unportable("group kind")
            opening, lookahead = "(" + self.take(2), kind != ":"
        self.out.append(opening)
        cost = max(1, self.alternatives(depth + 1))
        if self.peek() != ")":
            raise Unportable("unbalanced")
        self.out.append(self.take())
        return cost, lookahead

    def escape(self) -> str:
        self.take()
        c = self.take()
        if not c or ord(c) >= 0x80 or c.isdigit():
            raise Unportable("escape")
        if c == "x":
            hexes = self.take(2)
            if not regex.fullmatch(r"[0-9A-Fa-f]{2}", hexes):
                raise Unportable("escape")
            return r"\x" + hexes
        if c.isalpha() and c not in _LETTER_ESCAPES:
            raise Unportable("escape")
        return "\\" + c

    def char_class(self) -> None:
        parts = [self.take()]
        if self.peek() == "^":
            parts.append(self.take())
        first = True
        while True:
            c = self.peek()
            if not c:
                raise Unportable("unbalanced")
            if c == "]" and not first:
                parts.append(self.take())
                break
            if c == "[" and self.peek(2)[1:] in (":", ".", "="):
                kind = self.peek(2)[1]
                end = self.text.find(kind + "]", self.at + 2)
                if end < 0:
                    raise Unportable("unbalanced")
                name = self.text[self.at + 2 : end]
                if kind != ":" or name not in _POSIX:
                    raise Unportable("class name")
                parts.append(_POSIX[name])
                self.at = end + 2
            elif c == "\\":
                parts.append(self.escape())
            else:
                # Java reads these as operators of its own inside a class.
                parts.append("\\" + self.take() if c in "[]&" else self.take())
            first = False
        self.out.append("".join(parts))


def regex_filter(pattern: object) -> str | None:
    """Java pattern that matches whole values, case ignored; None for a pattern that may match nothing, being no portable one."""
    if not _usable(pattern):
        return None
    reader = _Reader(pattern)
    try:
        reader.alternatives(0)
        if reader.at < len(pattern):
            return None
        java = "".join(reader.out)
        regex.compile(java)
    except (Unportable, regex.error):
        return None
    return rf"(?ius)^(?:{java})\z"


def wildcard_filter(pattern: object) -> str | None:
    """Java pattern for * (any run) and ? (any character); all else stands for itself."""
    if not _usable(pattern):
        return None
    return r"(?ius)^" + "".join({"*": ".*", "?": "."}.get(c) or regex.escape(c, special_only=True) for c in pattern) + r"\z"


def _usable(pattern: object) -> bool:
    if not isinstance(pattern, str) or not pattern or "\0" in pattern:
        return False
    try:
        return len(pattern.encode()) <= MAX_BYTES
    except UnicodeEncodeError:
        return False
