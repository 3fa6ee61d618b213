"""Suffix-stripping stemmers after the published Snowball descriptions, for English, German, French and Spanish.

Languages without one here keep their words as they are; stop words still apply to them.
"""

from __future__ import annotations

from collections.abc import Callable


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """R1 and R2: after the first non-vowel that follows a vowel, and the same again within R1."""

    def after(low: int) -> int:
        for i in range(low + 1, len(word)):
            if word[i] not in vowels and word[i - 1] in vowels:
                return i + 1
        return len(word)

    r1 = after(0)
    return r1, after(r1)


def _ending(word: str, suffixes: list[str] | tuple[str, ...]) -> str:
    """The longest of the suffixes that the word ends in, or ''."""
    best = ""
    for s in suffixes:
        if len(s) > len(best) and word.endswith(s):
            best = s
    return best


# -- English

_EN_V = "aeiouy"
_EN_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_EN_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _en_short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _EN_V and w[1] not in _EN_V
    return len(w) > 2 and w[-3] not in _EN_V and w[-2] in _EN_V and w[-1] not in _EN_V + "wxY"


def english(word: str) -> str:
    w = word.replace("’", "'").lstrip("'")
    if len(w) <= 2:
        return w
    if w in _EN_SPECIAL:
        return _EN_SPECIAL[w]
    w = ("Y" if w[0] == "y" else w[0]) + "".join("Y" if c == "y" and w[i] in "aeiouy" else c for i, c in enumerate(w[1:]))
    vowels = _EN_V
    for start in ("gener", "commun", "arsen"):
        if w.startswith(start):
            r1 = len(start)
            r2 = r1 + _regions(w[r1:], vowels)[0]
            break
    else:
        r1, r2 = _regions(w, vowels)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in vowels for c in w[:-2]):
        w = w[:-1]
    if w.lower() in _EN_KEEP:
        return w.lower()
    s = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in vowels for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif _en_short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    s = _ending(w, tuple(_EN_2))
    if s and len(w) - len(s) >= r1 and not (s == "ogi" and w[-4:-3] != "l") and not (s == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(s)] + _EN_2[s]
    s = _ending(w, tuple(_EN_3))
    if s and len(w) - len(s) >= r1 and not (s == "ative" and len(w) - len(s) < r2):
        w = w[: -len(s)] + _EN_3[s]
    s = _ending(w, _EN_4)
    if s and len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _en_short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# -- German

_DE_V = "aeiouyäöü"


def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in _DE_V and w[i + 1] in _DE_V else c for i, c in enumerate(w))
    r1, r2 = _regions(w, _DE_V)
    r1 = max(r1, min(3, len(w)))
    s = _ending(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1:
        if s in ("em", "ern", "er"):
            w = w[: -len(s)]
        elif s in ("e", "en", "es"):
            w = w[: -len(s)]
            if w.endswith("niss"):
                w = w[:-1]
        elif w[-2:-1] in tuple("bdfghklmnrt"):
            w = w[:-1]
    s = _ending(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = _ending(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        stem = w[: -len(s)]
        if s in ("end", "ung"):
            w = stem
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            if not stem.endswith("e"):
                w = stem
        elif s in ("lich", "heit"):
            w = stem
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem
            t = _ending(w, ("lich", "ig"))
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
    return w.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


# -- Spanish and French share how they find RV

_ES_V = "aeiouáéíóúü"
_ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_ES_ACCENTS = str.maketrans("áéíóú", "aeiou")
_ES_VERBS_Y = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_ES_VERBS_GU = ("en", "es", "éis", "emos")
_ES_VERBS = (
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré", "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos", "eremos", "erá", "eré",
    "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré", "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an",
    "aban", "ían", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses", "ís",
    "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos",
)


def _es_rv(w: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in _ES_V:
        at = next((i for i in range(2, len(w)) if w[i] in _ES_V), None)
    elif w[0] in _ES_V:
        at = next((i for i in range(2, len(w)) if w[i] not in _ES_V), None)
    else:
        return 3
    return len(w) if at is None else at + 1


def spanish(word: str) -> str:
    w = word
    rv = _es_rv(w)
    r1, r2 = _regions(w, _ES_V)
    s = _ending(w, _ES_PRONOUNS)
    if s and len(w) - len(s) >= rv:
        stem = w[: -len(s)]
        t = _ending(stem, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if t and len(stem) - len(t) >= rv and (t != "yendo" or stem.endswith("uyendo")):
            w = stem[: -len(t)] + t.translate(_ES_ACCENTS)
    start = w
    step = (
        (("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"), r2, ""),
        (("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"), r2, ""),
        (("logía", "logías"), r2, "log"), (("ución", "uciones"), r2, "u"), (("encia", "encias"), r2, "ente"),
        (("amente",), r1, ""), (("mente",), r2, ""), (("idad", "idades"), r2, ""), (("iva", "ivo", "ivas", "ivos"), r2, ""),
    )
    s = _ending(w, [x for group, _, _ in step for x in group])
    if s:
        group, low, to = next(x for x in step if s in x[0])
        if len(w) - len(s) >= low:
            w = w[: -len(s)] + to
            more = {"amente": ("iv", "os", "ic", "ad"), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(s) or (("at",) if group[0] == "iva" else ("ic",) if group[0] == "adora" else ())
            t = _ending(w, more)
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
                if t == "iv" and s == "amente" and w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
    if w == start:
        s = _ending(w, _ES_VERBS_Y)
        if s and len(w) - len(s) >= rv and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _ending(w, _ES_VERBS + _ES_VERBS_GU)
            if s and len(w) - len(s) >= rv:
                w = w[: -len(s)]
                if s in _ES_VERBS_GU and w.endswith("gu"):
                    w = w[:-1]
    s = _ending(w, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s and len(w) - len(s) >= rv:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ES_ACCENTS)


_FR_V = "aeiouyâàëéêèïîôûù"
_FR_I = ("îmes", "ît", "îtes", "i", "ie", "ies", "ir", "ira", "irai", "iraIent", "irais", "irait", "iras", "irent", "irez", "iriez", "irions", "irons", "iront", "is", "issaIent", "issais", "issait", "issant", "issante", "issantes", "issants", "isse", "issent", "isses", "issez", "issiez", "issions", "issons", "it")
_FR_E = ("é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent", "erais", "erait", "eras", "erez", "eriez", "erions", "erons", "eront", "ez", "iez")
_FR_A = ("âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait", "ant", "ante", "antes", "ants", "as", "asse", "assent", "asses", "assiez", "assions")


def _fr_marks(word: str) -> str:
    out = list(word)
    for i, c in enumerate(word):
        back, front = word[i - 1] if i else "", word[i + 1] if i + 1 < len(word) else ""
        if c in "ui" and back and front and back in _FR_V and front in _FR_V or c == "y" and (back and back in _FR_V or front and front in _FR_V) or c == "u" and back == "q":
            out[i] = c.upper()
    return "".join(out)


def french(word: str) -> str:
    w = _fr_marks(word)
    if w.startswith(("par", "col", "tap")):
        rv = 3
    elif len(w) > 2 and w[0] in _FR_V and w[1] in _FR_V:
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _FR_V), len(w))
    r1, r2 = _regions(w, _FR_V)
    start, verb = w, True
    rules = (
        (("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"), "simple"), (("atrice", "ateur", "ation", "atrices", "ateurs", "ations"), "ation"),
        (("logie", "logies"), "log"), (("usion", "ution", "usions", "utions"), "u"), (("ence", "ences"), "ent"), (("ement", "ements"), "ement"), (("ité", "ités"), "ite"),
        (("if", "ive", "ifs", "ives"), "if"), (("eaux",), "eau"), (("aux",), "al"), (("euse", "euses"), "eux"), (("issement", "issements"), "issement"), (("amment",), "ant"), (("emment",), "ent_"), (("ment", "ments"), "ment"),
    )
    s = _ending(w, [x for group, _ in rules for x in group])
    kind = next((k for group, k in rules if s in group), "") if s else ""
    stem = w[: len(w) - len(s)]

    def strip(x: str, suffix: str, low: int) -> tuple[str, bool]:
        return (x[: -len(suffix)], True) if x.endswith(suffix) and len(x) - len(suffix) >= low else (x, False)

    if kind in ("simple", "ation", "log", "u", "ent") and len(stem) >= r2:
        w, verb = stem + {"log": "log", "u": "u", "ent": "ent"}.get(kind, ""), False
        if kind == "ation":
            cut, ok = strip(w, "ic", r2)
            w = cut if ok else w[:-2] + "iqU" if w.endswith("ic") else w
    elif kind == "ement" and len(stem) >= rv:
        w, verb = stem, False
        if w.endswith("iv") and len(w) - 2 >= r2:
            w = w[:-2]
            w = strip(w, "at", r2)[0]
        elif w.endswith("eus"):
            w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
        elif w.endswith(("abl", "iqU")):
            w = strip(w, w[-3:], r2)[0]
        elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
            w = w[:-3] + "i"
    elif kind == "ite" and len(stem) >= r2:
        w, verb = stem, False
        if w.endswith("abil"):
            w = w[:-4] if len(w) - 4 >= r2 else w[:-4] + "abl"
        elif w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif w.endswith("iv"):
            w = strip(w, "iv", r2)[0]
    elif kind == "if" and len(stem) >= r2:
        w, verb = stem, False
        cut, ok = strip(w, "at", r2)
        if ok:
            w = cut
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    elif kind == "eau":
        w, verb = stem + "eau", False
    elif kind == "al" and len(stem) >= r1:
        w, verb = stem + "al", False
    elif kind == "eux" and len(stem) >= r1:
        w, verb = (stem if len(stem) >= r2 else stem + "eux"), False
    elif kind == "issement" and len(stem) >= r1 and stem[-1:] not in tuple(_FR_V):
        w, verb = stem, False
    elif kind in ("ant", "ent_") and len(stem) >= rv:
        w = stem + kind.rstrip("_")
    elif kind == "ment" and len(stem) > rv and stem[-1] in _FR_V:
        w = stem
    changed = w != start
    if verb or not changed:
        before = w
        s = _ending(w, _FR_I)
        if s and len(w) - len(s) > rv and w[-len(s) - 1] not in _FR_V:
            w = w[: -len(s)]
        elif w == before:
            s = _ending(w, ("ions",) + _FR_E + _FR_A)
            if s == "ions":
                w = strip(w, "ions", max(r2, rv))[0]
            elif s and len(w) - len(s) >= rv:
                w = w[: -len(s)]
                if s in _FR_A and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        changed = changed or w != before
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès"):
            w = w[:-1]
        s = _ending(w, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if s == "ion":
            if len(w) - 3 >= r2 and len(w) - 3 > rv and w[-4:-3] in ("s", "t"):
                w = w[:-3]
        elif s in ("ier", "ière", "Ier", "Ière") and len(w) - len(s) >= rv:
            w = w[: -len(s)] + "i"
        elif s == "e" and len(w) - 1 >= rv or s == "ë" and len(w) - 1 >= rv and w[-3:-1] == "gu":
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    last = next((i for i in range(len(w) - 1, -1, -1) if w[i] in _FR_V), None)
    if last is not None and last < len(w) - 1 and w[last] in "éè":
        w = w[:last] + "e" + w[last + 1 :]
    return w.lower()


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "german": german, "spanish": spanish, "french": french}
