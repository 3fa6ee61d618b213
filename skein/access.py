"""Access tokens: who may see a document, and what a viewer holds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name that stands for every user.
EVERYONE = "__all"


@dataclass(frozen=True)
class Access:
    """A document's owner and shares, or a viewer with their groups and circles."""

    owner: str = ""
    viewer: str = ""
    users: Sequence[str] = ()
    groups: Sequence[str] = ()
    circles: Sequence[str] = ()
    links: Sequence[str] = ()


def usable(name: object) -> bool:
    if not isinstance(name, str) or not name or "\0" in name:
        return False
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def viewer_tokens(access: Access) -> list[str]:
    """Tokens of a viewer; none for a blank one. A viewer called like everyone also holds the owner token of that name."""
    if not usable(access.viewer):
        return []
    out = [f"u:{access.viewer}", f"u:{EVERYONE}"]
    if access.viewer == EVERYONE:
        out.append(f"o:{EVERYONE}")
    out += [f"g:{g}" for g in access.groups if usable(g)] + [f"c:{c}" for c in access.circles if usable(c)]
    return list(dict.fromkeys(out))


def document_tokens(access: Access) -> list[str]:
    out = [("o:" if access.owner == EVERYONE else "u:") + access.owner] if usable(access.owner) else []
    out += [f"{k}:{x}" for k, names in (("u", access.users), ("g", access.groups), ("c", access.circles)) for x in names if usable(x)]
    return list(dict.fromkeys(out))


def document_tokens_column(owner: Column, users: Column, groups: Column, circles: Column) -> Column:
    """The same from columns: a string and three arrays of strings."""
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "") & ~x.contains("\0"))
    own = F.when(owner == EVERYONE, F.concat(F.lit("o:"), owner)).otherwise(F.concat(F.lit("u:"), owner))
    first = F.when(owner.isNotNull() & (owner != "") & ~owner.contains("\0"), F.array(own)).otherwise(F.array().cast("array<string>"))
    rest = [F.transform(clean(users), lambda x: F.concat(F.lit("u:"), x)), F.transform(clean(groups), lambda x: F.concat(F.lit("g:"), x)), F.transform(clean(circles), lambda x: F.concat(F.lit("c:"), x))]
    return F.array_distinct(F.concat(first, *rest))


def access_of(tokens: Column, kind: str) -> Column:
    """Names with the given kind of token: u, g, c or o."""
    return F.transform(F.filter(tokens, lambda t: t.startswith(f"{kind}:")), lambda t: F.substring(t, 3, 1 << 30))
