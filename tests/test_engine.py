import logging
import random
import shutil

import pytest
from helpers import FIELDS, ME, doc, frame, ids
from pyspark.sql import functions as F

from skein.access import Access
from skein.functions.trigram import word_similarity_text
from skein.model import CONTENT, INCOMING, META, OK, SearchRequest, SimpleQuery
from skein.operators.expand import similar_titles
from skein.plans import build
from skein.plans.engine import Engine, NotFound, with_settings
from skein.plans.store import Conflict, Incomplete
from skein.settings import Settings

DOCS = [
    doc("lic", "license_v2.txt", "The quick brown foxes ran over the lazy dog while reading the public license.", tags=["legal"], metatags=["files_local"], subtags={"src": ["x", "y"]}),
    doc("one", "one line", "alpha beta gamma", modified_time=1_700_000_100, info='{"n": 7, "ok": true, "name": "Delta", "list": ["p", "q"]}', parts={"comments": "hidden remark"}),
    doc("two", "Report2024-final.pdf", "beta beta delta", modified_time=1_700_000_200),
    doc("priv", "private alpha", "alpha secretword", owner="bob"),
    doc("pub", "shared", "alpha omega", owner="bob", users=["__all"]),
    doc("grp", "grouped", "alpha theta", owner="bob", groups=["g1"]),
    doc("cafe", "café déjà", "un café très agréable"),
    doc("mail", "contacts", "write to jane.doe@example.com or see example.com/help about e-mail"),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    e.index(frame(spark, DOCS), now=1)
    return e


def test_access(engine):
    assert set(ids(engine, "alpha")) == {"one", "pub"}
    assert set(ids(engine, "alpha", Access(viewer="bob"))) == {"priv", "pub", "grp"}
    assert set(ids(engine, "alpha", Access(viewer="eve", groups=["g1"]))) == {"pub", "grp"}
    assert ids(engine, "alpha", Access()) == []
    assert engine.search(SearchRequest("alpha", provider="other"), ME).total == 0


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("alpha gamma", {"one", "pub"}),
        ("+alpha +gamma", {"one"}),
        ("alpha -omega", {"one"}),
        ("-alpha", set()),
        ('"beta gamma"', {"one"}),
        ('"gamma beta"', set()),
        ("alph", {"one", "pub"}),
        ("beta OR omega", {"one", "two", "pub"}),
        ("the", set()),
        ("fox", {"lic"}),
        ("+the +fox", {"lic"}),
        ('"over the lazy"', {"lic"}),
        ("example.com", {"mail"}),
        ("jane.doe@example.com", {"mail"}),
        ("e-mail", {"mail"}),
        ("report 2024", {"two"}),
        ("eport20", {"two"}),
        ("-alp omega", {"pub"}),
        ("hidden", {"one"}),
        ("(alpha), omega!", {"one", "pub"}),
    ],
)
def test_queries(engine, query, expected):
    assert set(ids(engine, query)) == expected


def test_order_and_scores(engine):
    result = engine.search(SearchRequest("beta delta", provider="files"), ME)
    assert [d["document_id"] for d in result.documents] == ["two", "one"]
    result = engine.search(SearchRequest("beta", provider="files"), ME)
    assert [(d["document_id"], d["score"]) for d in result.documents] == [("two", "16.67"), ("one", "9.09")]
    assert result.max_score == 17 and result.total == 2


def test_expansion(engine):
    assert ids(engine, "cafe") == ["cafe"]
    assert ids(engine, "gamam") == ["one"]
    assert ids(engine, "secretwrod") == []  # only in a document that the viewer can't see


def test_filters(engine):
    assert ids(engine, "fox", metatags=["files_local"]) == ["lic"] and ids(engine, "fox", metatags=["other"]) == []
    assert ids(engine, "fox", subtags=["src_x", "src_y"]) == ["lic"] and ids(engine, "fox", subtags=["src_x", "src_z"]) == []
    assert ids(engine, "beta", since=1_700_000_150) == ["two"] and ids(engine, "beta", until=1_700_000_100) == ["one"]
    assert ids(engine, "beta", wildcards=[[("title", "REPORT*.p?f")]]) == ["two"] and ids(engine, "beta", wildcards=[[("title", "eport*")]]) == []
    assert ids(engine, "beta", regexes=[[("title", "one (line|word)")]]) == ["one"] and ids(engine, "beta", regexes=[[("title", r"(o)\1")]]) == []
    assert ids(engine, "beta", limit_fields=["title"]) == [] and ids(engine, "hidden", limit_fields=["parts"]) == ["one"] and ids(engine, "legal", limit_fields=["tags"]) == ["lic"]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        (SimpleQuery("int_eq", "info.n", [7]), ["one"]),
        (SimpleQuery("int_gt", "n", ["7"]), []),
        (SimpleQuery("int_lte", "n", [10**50]), ["one"]),
        (SimpleQuery("bool", "ok", ["true"]), ["one"]),
        (SimpleQuery("keyword", "name", ["Delta", "x"]), ["one"]),
        (SimpleQuery("array", "list", [["q"]]), ["one"]),
        (SimpleQuery("wildcard", "info.name", ["del*"]), ["one"]),
        (SimpleQuery("keyword", "tags", ["legal"]), ["lic"]),
        (SimpleQuery("text", "tags", ["leg"]), ["lic"]),
        (SimpleQuery("text", "tags", ["-legal"]), []),
        (SimpleQuery("text", "parts", ["remark"]), []),
        (SimpleQuery("text", "parts.comments", ["remark"]), ["one"]),
        (SimpleQuery("regex", "title", [".*final.*"]), ["two"]),
        (SimpleQuery("int_gte", "lastModified", [1_700_000_200]), ["two"]),
        (SimpleQuery("keyword", "access", ["u:ann"]), []),
        (SimpleQuery("keyword", "missing", ["x"]), []),
        (SimpleQuery("int_eq", "name", [7]), []),
    ],
)
def test_simple_queries(engine, query, expected):
    assert ids(engine, "", empty_search=True, simple=[query]) == expected


def test_paging_and_empty_search(engine):
    first = engine.search(SearchRequest("alpha beta omega", provider="files", size=2), ME)
    second = engine.search(SearchRequest("alpha beta omega", provider="files", size=2, page=2), ME)
    past = engine.search(SearchRequest("alpha beta omega", provider="files", size=2, page=9), ME)
    assert first.total == second.total == past.total == 3 and len(first.documents) == 2 and len(second.documents) == 1 and not past.documents
    assert ids(engine, "", empty_search=True, size=2) == ["two", "one"] and ids(engine, "") == []


def test_title_fallback(engine):
    plain = with_settings(engine, typo_correction=False)
    assert ids(plain, "groupedd", Access(viewer="bob")) == ["grp"] and ids(plain, "+groupedd", Access(viewer="bob")) == []
    assert ids(plain, "groupedd", Access(viewer="bob"), limit_fields=["content"]) == []


def test_excerpts(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("long", "t", "filler " * 30_000 + "needle " + "filler " * 1000)]), now=1)
    found = e.search(SearchRequest("needle", provider="files"), ME).documents[0]["excerpts"]
    assert found and "needle" in found[0]["excerpt"] and len(found[0]["excerpt"].split()) <= 30


def test_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("a", "first", "apple"), doc("b", "second", "banana")]), now=1)
    e.index(frame(spark, [doc("a", "renamed", "ignored", status=META), doc("c", "third", "cherry")]), now=2)
    assert ids(e, "apple") == ["a"] and ids(e, "renamed") == ["a"] and ids(e, "ignored") == [] and ids(e, "cherry") == ["c"]
    before = {r["document_id"]: r["id"] for r in e.store.table("docs").collect()}
    e.index(frame(spark, [doc("a", "again", "avocado", status=CONTENT | OK)]), now=3)
    assert {r["document_id"]: r["id"] for r in e.store.table("docs").collect()} == before
    assert ids(e, "avocado") == ["a"] and ids(e, "apple") == []
    words = {r["word"] for r in e.store.table("words").collect()}
    assert "apple" in words
    e.rebuild_vocabulary()
    assert "apple" not in {r["word"] for r in e.store.table("words").collect()}
    e.delete([("files", "b"), ("files", "none")])
    assert ids(e, "banana") == []
    assert e.document("files", "a")["title"] == "again"
    with pytest.raises(NotFound):
        e.document("files", "b")
    e.reset("all")
    assert e.status()["documents"] == 0 and e.status()["words"] == 0


def test_round_trip(engine):
    d = engine.document("files", "lic")
    assert d["owner"] == "ann" and d["users"] == [] and d["subtags"] == {"src": ["x", "y"]} and d["title"] == "license_v2.txt"


def test_languages(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"), Settings(language="english,german"))
    e.index(frame(spark, [doc("e", "", "the cats and the dogs were in the house"), doc("d", "", "die Häuser und die Katzen sind in der Stadt"), doc("n", "", "xyz")]), now=1)
    assert {r["document_id"]: r["config"] for r in e.store.table("docs").collect()} == {"e": "english", "d": "german", "n": "english"}
    assert ids(e, "cat") == ["e"] and ids(e, "katze") == ["d"]


def test_privacy(spark, tmp_path):
    """Another user's documents change neither results nor ranks nor corrections."""
    e = Engine(spark, str(tmp_path / "i"))
    own = [doc("a", "", "common zanzibar"), *[doc(f"c{i}", "", "common") for i in range(5)]]
    e.index(frame(spark, own), now=1)
    before = e.search(SearchRequest("common zanzibar", provider="files"), ME)
    e.index(frame(spark, [doc(f"x{i}", "", "zanzibar zanzibra", owner="bob") for i in range(8)]), now=2)
    after = e.search(SearchRequest("common zanzibar", provider="files"), ME)
    assert [d["document_id"] for d in before.documents] == [d["document_id"] for d in after.documents] and before.total == after.total


def test_rebuild_and_alternatives(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("d", "", "die Häuser und die Katzen sind in der Stadt")]), now=1)
    assert ids(e, "katzen haus") == ["d"] and e.configure({"language": "german,english"})
    e.rebuild()
    assert e.store.table("docs").first()["config"] == "german" and ids(e, "+haus") == ["d"]
    assert e.alternatives("hauser kazten", SearchRequest(provider="files"), ME) == {"hauser": ["häuser"], "kazten": ["katzen"]}
    e.store.vacuum()
    assert ids(e, "+haus") == ["d"]


def test_degrade(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("big", "kept", " ".join(f"word{i}" for i in range(2000))), doc("small", "kept", "tiny")]), now=1, max_vector_bytes=20_000)
    rows = {r["document_id"]: r for r in e.store.table("docs").collect()}
    assert rows["small"]["warning"] == "" and rows["big"]["warning"] == "content cut to a half" and ids(e, "word10") == ["big"] and ids(e, "word1990") == []


def test_sub_tags(spark):
    from skein.plans.build import sub_tags_of_list

    df = spark.createDataFrame([(["a_x", "a_y_z", "b_q", "plain", "_e", "a_x"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(sub_tags_of_list("t")).collect()] == [{"a": ["x", "y_z"], "b": ["q"]}, {}]


def test_timeout(engine):
    slow = with_settings(engine, search_timeout=1)
    slow._search = lambda request, access: slow.spark.range(10**12).selectExpr("sum(id % 7)").collect()
    result = slow.search(SearchRequest("x", provider="files"), ME)
    assert result.timed_out and result.documents == []


def test_text_condition_is_a_search(spark, tmp_path):
    """On title and content signs, quotes and prefixes count, as in a search limited to the field."""
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("1", "yearly plan 2024", "the final plan is drawn up"), doc("2", "draft memo", "a draft of the plan")]), now=1)

    def found(field, text):
        return sorted(ids(e, "", empty_search=True, simple=[SimpleQuery("text", field, [text])]))

    assert found("title", "yea") == ["1"] and found("title", "+plan -draft") == ["1"] and found("title", "plan memo") == ["1", "2"]
    assert found("content", "plan -draft") == ["1"] and found("content", '"final plan"') == ["1"] and found("content", '"plan final"') == []
    assert found("title", "earl") == [] and found("content", "-draft") == [] and found("content", "") == []


def test_settings_stay_with_the_index(spark, tmp_path):
    path = str(tmp_path / "i")
    Engine(spark, path, Settings(language="german", max_results=7)).index(frame(spark, [doc("d", "", "die alten Häuser")]), now=1)
    again = Engine(spark, path)
    assert again.settings.language == "german" and again.settings.max_results == 7 and ids(again, "haus") == ["d"]
    assert again.configure({"max_results": 9}) is False and Engine(spark, path).settings.max_results == 9
    assert Engine(spark, path, Settings()).settings.language == "english"


def test_two_writers(spark, tmp_path):
    """Two changes made from one state: the second is tried again on what the first left, and nothing is lost."""
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("a", "", "apple")]), now=1)
    write, raced = e._write, []

    def late(snap, *rest):
        if not raced:
            raced.append(snap.meta["state"])
            Engine(spark, str(tmp_path / "i")).index(frame(spark, [doc("b", "", "banana")]), now=2)
        write(snap, *rest)

    e._write = late
    e.index(frame(spark, [doc("c", "", "cherry")]), now=3)
    assert raced and [ids(e, w) for w in ("apple", "banana", "cherry")] == [["a"], ["b"], ["c"]]
    snap = e.store.snapshot()
    e.store.commit(snap, {})
    with pytest.raises(Conflict):
        e.store.commit(snap, {})


def test_a_write_that_dies(spark, tmp_path):
    """Between tables nothing of a change shows, readers keep their state, and no work folder is left."""
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("a", "", "apple")]), now=1)
    before, held = e.store.meta(), e.store.snapshot()
    add, calls = e.store.add, []

    def dies(tables):
        calls.append(tables)
        if len(calls) == 2:
            raise OSError("no room")
        return add(tables)

    e.store.add = dies
    with pytest.raises(OSError):
        e.index(frame(spark, [doc("a", "", "avocado")]), now=2)
    assert e.store.meta() == before and ids(e, "apple") == ["a"] and ids(e, "avocado") == []
    assert not [p for p in (tmp_path / "i").iterdir() if p.name.startswith("_work")]
    e.store.add = add
    e.index(frame(spark, [doc("a", "", "avocado")]), now=3)
    assert ids(e, "avocado") == ["a"] and held.table("docs").first()["content"] == "apple"


@pytest.mark.parametrize("name", ["postings", "surface", "words"])
def test_a_lost_table_is_built_anew(spark, tmp_path, name):
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("a", "red title", "apple"), doc("b", "", "banana")]), now=1)
    shutil.rmtree(tmp_path / "i" / e.store.meta()["tables"][name])
    assert [n for n, there in e.status()["tables"].items() if not there] == [name] and e.status()["documents"] == 2
    with pytest.raises(Incomplete):
        e.load()
    e.initialize()
    assert all(e.status()["tables"].values()) and ids(e, "apple") == ["a"] and ids(e, "aplle") == ["a"]


def test_lost_documents_are_no_empty_index(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("a", "", "apple")]), now=1)
    shutil.rmtree(tmp_path / "i" / e.store.meta()["tables"]["docs"])
    with pytest.raises(Incomplete):
        e.initialize()


def test_info_and_listed_sub_tags(spark):
    raw = [r'{"a\u0000b": "c\u0000\u0000d"}', r'{"a": "back\\u0000"}', r'{"a": "\\\u0000x"}', "{\0}", None]
    rows = spark.createDataFrame([tuple((doc(str(i)) | {"info": x})[f] for f in FIELDS) for i, x in enumerate(raw)], INCOMING)
    rows = rows.withColumn("subtags", F.array(F.lit("mail_in_box"), F.lit("mail_sent"), F.lit("mail_sent"), F.lit("_x"), F.lit("none"), F.lit(None)))
    got = sorted(build.index_rows(rows, Settings(language="simple"), 0).select("document_id", "info", "subtags_map", "subtags").collect())
    assert [r["info"] for r in got] == ['{"ab": "cd"}', r'{"a": "back\\u0000"}', r'{"a": "\\x"}', "{}", "{}"]
    assert all(r["subtags_map"] == {"mail": ["in_box", "sent"]} and r["subtags"] == ["mail_in_box", "mail_sent"] for r in got)


def test_similar_titles_are_all_found(spark):
    """The filter before the distance function leaves out no title that it would keep."""
    rng = random.Random(3)
    titles = [" ".join("".join(rng.choice("abcé1") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(titles)), "id long, title_search string")
    for text in (*titles[:6], "abc", "é1 ab", ""):
        for least in (0.3, 0.6, 1.0):
            want = {(i, round(x, 9)) for i, t in enumerate(titles) if text and (x := word_similarity_text(text, t)) >= least}
            assert {(r["id"], round(r["alike"], 9)) for r in similar_titles(docs, text, least).collect()} == want


def test_unknown_languages_are_named(caplog):
    with caplog.at_level(logging.WARNING):
        assert Settings(language="german,klingon").languages == ["german"] and Settings(language="volapük").languages == ["simple"]
    assert "klingon" in caplog.text and "volapük" in caplog.text
