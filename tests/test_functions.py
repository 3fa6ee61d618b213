import random

import pytest
from pyspark.sql import functions as F

from skein.access import Access, access_of, document_tokens, document_tokens_column, viewer_tokens
from skein.functions import text as T
from skein.functions.analyzer import lexeme, stop_words
from skein.functions.patterns import regex_filter, wildcard_filter
from skein.functions.stem import english, french, german, spanish
from skein.functions.trigram import osa, osa_distance, similarity, similarity_text, trigrams, word_similarity_text
from skein.operators.excerpt import fragments, window
from skein.operators.match import idf
from skein.operators.query import Element, Term, parse, sequences
from skein.settings import SettingError, Settings


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_fold_tables():
    assert len(T.FOLD_FROM) == len(T.FOLD_TO) == 50 and T.fold_text("çäłñ") == "caln"


@pytest.mark.parametrize("text", ["İstanbul IĞDIR", "i̇x", "Ünï-Cödé ß", "", "see jane.doe@example.com, example.com/help e-mail v2", "a-b-c x.y 3.14 a.1b"])
def test_columns_match_python(spark, text):
    [(low, fold, tok, split)] = values(spark, [(text,)], "t string", T.lower(F.col("t")), T.fold(F.col("t")), T.tokens(F.col("t")), T.split_title(F.col("t")))
    assert (low, fold, tok, split) == (T.lower_text(text), T.fold_text(text), T.tokens_text(text), T.split_title_text(text))


def test_tokens():
    assert T.tokens_text("e-mail Jane.Doe@Example.com https://example.com/a/b file_v2.txt") == ["e-mail", "e", "mail", "jane.doe@example.com", "https", "example.com/a/b", "example.com", "file", "v2.txt"]
    assert T.split_title_text("Report2024-final_v2.pdf") == "Report 2024 final v 2 pdf"


def test_turkish(spark):
    got = values(spark, [("Iİ", "turkish"), ("Iİ", "english")], "t string, c string", T.lower(T.turkish(F.col("t"), F.col("c"))))
    assert got == [("ıi",), ("ii",)]


@pytest.mark.parametrize(("a", "b", "n"), [("recieve", "receive", 1), ("cat", "cats", 1), ("abc", "xyz", 3), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0)])
def test_distance(spark, a, b, n):
    assert osa(a, b) == osa(b, a) == n
    assert values(spark, [(a, b)], "a string, b string", osa_distance("a", "b")) == [(n,)]


def test_similarity(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))) for _ in range(50)]
    got = values(spark, pairs, "a string, b string", similarity(trigrams(F.col("a")), trigrams(F.col("b"))))
    assert [round(x, 9) for (x,) in got] == [round(similarity_text(a, b), 9) for a, b in pairs]
    assert word_similarity_text("word", "two words") == pytest.approx(0.8) and word_similarity_text("", "x") == 0


@pytest.mark.parametrize(
    ("f", "pairs"),
    [
        (english, {"running": "run", "flies": "fli", "happily": "happili", "nationality": "nation", "hopping": "hop", "hoping": "hope", "generously": "generous", "skies": "sky", "relational": "relat", "conditional": "condit", "agreed": "agre", "falling": "fall", "by": "by", "say": "say", "enjoyment": "enjoy"}),
        (german, {"häuser": "haus", "katzen": "katz", "aufgaben": "aufgab", "freundlichkeit": "freundlich", "bäume": "baum", "spielen": "spiel", "kenntnisse": "kenntnis"}),
        (french, {"continuellement": "continuel", "majestueusement": "majestu", "maisons": "maison", "chevaux": "cheval", "nationalité": "national", "mangeaient": "mang", "finissons": "fin"}),
        (spanish, {"corriendo": "corr", "canciones": "cancion", "rápidamente": "rapid", "niños": "niñ", "hablaban": "habl", "libertad": "libert", "nacional": "nacional"}),
    ],
)
def test_stems(f, pairs):
    assert {w: f(w) for w in pairs} == pairs


def test_stop_words(spark):
    assert lexeme("the", "english") is None and lexeme("the", "simple") == "the" and "und" in stop_words("german") and "ve" in stop_words("turkish")


@pytest.mark.parametrize("pattern", [r"a+", r"(ab|c){2,5}?", r"[[:alpha:]_]+\d", r"x{3}", r"a(?=b)b", r"[]a]", r"\.\*", "[^a-z]", "a{,3}", "", "ü*"][:-2] + ["ü*"])
def test_portable(pattern):
    assert regex_filter(pattern)


@pytest.mark.parametrize("pattern", ["", "a\0", "x" * 257, r"(a)\1", r"\bword", r"\p{L}", r"(?<=a)b", r"(?P<n>a)", "(?>a)", "a++", "a*+", "(?=a)*", "a{256}", "(a{100}){100}", "(*UTF8)a", "(a", "a)", "[a", r"\x{41}", "[[.a.]]", "a\\", None, 7])
def test_unportable(pattern):
    assert regex_filter(pattern) is None


def test_patterns_match(spark):
    rows = [("Report.PDF",), ("report pdf",), ("100%_x",), ("ÄRGER",), ("two\nlines",)]
    hit = lambda p: [t for t, ok in values(spark, rows, "t string", "t", F.col("t").rlike(p)) if ok]
    assert hit(wildcard_filter("report.*")) == ["Report.PDF"] and hit(wildcard_filter("100%_?")) == ["100%_x"] and hit(wildcard_filter("ärger")) == ["ÄRGER"]
    assert hit(regex_filter("report[[:punct:] ]pdf")) == ["Report.PDF", "report pdf"] and hit(regex_filter("two.lines")) == ["two\nlines"] and hit(regex_filter("two")) == []


@pytest.mark.parametrize(
    ("text", "required", "optional", "excluded", "plain"),
    [
        ("alpha beta", [], ["alpha", "beta"], [], True),
        ("alpha OR beta", [], ["alpha", "beta"], [], True),
        ("+alpha -beta", ["alpha"], [], ["beta"], False),
        ('"alpha beta" gamma', [], ["alpha beta", "gamma"], [], False),
        ('"alpha beta', [], ["alpha beta"], [], False),
        ("(alpha), beta!", [], ["alpha", "beta"], [], True),
        ("alpha -", [], ["alpha"], [], True),
        ("+OR alpha", ["OR"], ["alpha"], [], False),
        ("al\0pha be\x07ta", [], ["alpha", "beta"], [], True),
    ],
)
def test_parse(text, required, optional, excluded, plain):
    q = parse(text)
    assert ([t.text for t in q.required], [t.text for t in q.optional], [t.text for t in q.excluded], q.plain) == (required, optional, excluded, plain)


def test_parse_bounds():
    assert parse("-alpha") is None and parse("") is None and parse(" ".join(f"+w{i}" for i in range(33))) is None
    q = parse(" ".join(f"w{i}" for i in range(99)) + " +r")
    assert len(q.optional) == 31 and len(parse("x" * 500).optional[0].text) == 100


def test_sequences(spark):
    assert sequences(Term("the"), "english") == [] and sequences(Term("foxes"), "english") == [(Element(0, "fox", True),)]
    assert sequences(Term("foxes"), "english", exact=True) == [(Element(0, "fox", False),)]
    assert sequences(Term("over the moon", True), "english") == [(Element(0, "moon", False),)]
    assert sequences(Term("jump the moon", True), "english") == [(Element(0, "jump", False), Element(2, "moon", False))]
    assert (Element(0, "report", True), Element(1, "2024", True)) in sequences(Term("Report2024"), "simple")


def test_idf():
    assert idf(30, 51) == pytest.approx(0.534, abs=1e-3) and idf(1, 51) == pytest.approx(3.546, abs=1e-3) and idf(60, 51) > 0


def test_tokens_of_access(spark):
    a = Access(owner="__all", users=["x", "", "x"], groups=["g\0", "h"], circles=["c"])
    assert document_tokens(a) == ["o:__all", "u:x", "g:h", "c:c"]
    assert viewer_tokens(Access()) == [] and viewer_tokens(Access(viewer="__all")) == ["u:__all", "o:__all"]
    rows = [("__all", ["x", "", "x"], ["h"], None), (None, None, None, None)]
    got = values(spark, rows, "o string, u array<string>, g array<string>, c array<string>", document_tokens_column(*map(F.col, "ougc")))
    assert got == [(["o:__all", "u:x", "g:h"],), ([],)]
    assert values(spark, [(["u:a", "g:b"],)], "t array<string>", access_of(F.col("t"), "g")) == [(["b"],)]


def test_settings():
    s, changed = Settings().changed({"language": "German, english", "max_results": "50", "use_trigram": "no"})
    assert changed and s.languages == ["german", "english"] and s.max_results == 50 and not s.use_trigram
    assert not s.changed({"language": ["german", "english"]})[1]
    for bad in ({"nope": 1}, {"language": ""}, {"language": "klingon"}, {"language": "english,german,french,spanish,danish,dutch"}, {"max_results": 0}, {"search_timeout": "x"}, {"use_trigram": "maybe"}, {"pdf_extractor": "magic"}, {"pdftotext_path": "/bin/sh"}):
        with pytest.raises(SettingError):
            s.changed(bad)
    assert Settings(language="klingon").languages == ["simple"] and Settings(max_results=99_999, search_timeout=-4).clamped().max_results == 10_000


def test_windows():
    text = "pad " * 60_000 + "needle " + "pad " * 10
    assert "needle" in window(text, ["needle"], "simple") and len(window(text, ["needle"], "simple")) <= 10_000
    assert fragments("short text", ["missing"], "simple") == ["short text"] and fragments("", ["x"], "simple") == []
    assert fragments("İZMİR ve ISPARTA", ["ısparta"], "turkish") == ["İZMİR ve ISPARTA"]


def test_fuzz():
    """No query text raises."""
    rng = random.Random(1337)
    alphabet = ["alpha", "+", "-", '"', " ", "OR", "\0", "\x07", "İ", "(", ")", "|", "&", ":*", "\\", "'", "é", "%", "_", "<->", "!", "\ud800", "中"]
    for _ in range(2500):
        q = parse("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))), rng.choice(["simple", "english", "turkish"]))
        for t in q.positive if q else ():
            sequences(t, "simple")
        regex_filter("".join(rng.choice("ab([{}])*+?|\\^$.:d9,") for _ in range(rng.randint(0, 12))))
