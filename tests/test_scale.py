"""What must hold on larger and odder tables: whole texts, rows that share an id, and plans whose work grows with the input."""

import os
import random
import re

import duckdb
import pytest

import __spark_entry__ as entries
from skein.functions.trigram import trigrams_text
from skein.operators import expand, match
from skein.plans import build, queries
from skein.sources import corpus

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same_as_sql(spark, folder, name, **tables):
    df = queries.QUERIES[name](spark, folder)
    c = duckdb.connect()
    for t in os.listdir(folder):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}/*.parquet'")
    for t, path in tables.items():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({entries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


ODD = [(1, "word " * 250_000), (2, "a <b>bold</b> <p>one</p> <br/>"), (3, ""), (4, None), (5, "plain text\n of two lines")]


@pytest.mark.parametrize("name", ["index_rows", "upsert_partial"])
def test_index_rows_keeps_whole_plain_texts(spark, tmp_path, name):
    """nothing is cut at a million bytes or taken for markup."""
    same_as_sql(spark, texts(spark, tmp_path, ODD), name)


TWICE = [(1, "a b a of the c-d"), (1, "a x b of the"), (2, "a b"), (3, "x.org/y z " * 300), (4, None), (5, "")]


@pytest.mark.parametrize("name", ["build_postings", "document_frequency"])
def test_rows_that_share_an_id(spark, tmp_path, name):
    same_as_sql(spark, texts(spark, tmp_path, TWICE), name)


def test_postings_are_made_in_rows(spark):
    """nothing but texts is shuffled, and nothing is aggregated."""
    p = plan(queries.build_postings(spark, DATA))
    assert "Aggregate" not in p and p.count("Exchange") == 1


def test_terms_of_languages(spark):
    """Arrays of stems in two languages at once, stop words, and the words behind each lexeme."""
    docs = spark.createDataFrame([(1, "english", "running runs the run"), (2, "german", "häuser haus der"), (3, "simple", "running the"), (4, "english", "")], "id long, config string, content string")
    docs = docs.selectExpr("*", "'' AS title", "'' AS tags_text", "'' AS parts_text")
    rows = {(r["id"], r["lexeme"]): (r["positions"], sorted(r["words"])) for r in build.terms(docs, ["english", "german", "simple"]).collect()}
    assert rows[1, "run"] == ([1, 2, 4], ["run", "running", "runs"]) and rows[1, None] == ([3], ["the"])
    assert rows[2, "haus"] == ([1, 2], ["haus", "häuser"]) and rows[2, None] == ([3], ["der"])
    assert rows[3, "running"] == ([1], ["running"]) and rows[3, "the"] == ([2], ["the"]) and len(rows) == 6


def test_best_of_each_query(spark, monkeypatch):
    """the same as counting all pairs, with ties, unknown words, batches that cut documents, and small pieces."""
    monkeypatch.setattr(match, "PAIRS", 50)
    rng = random.Random(3)
    docs = {i: {f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))} for i in rng.sample(range(-500, 500), 400)}
    asked = {q: {f"w{rng.randint(0, 33)}" for _ in range(rng.randint(1, 8))} for q in range(20)}
    own = spark.createDataFrame([(w, i) for i, ws in docs.items() for w in ws], "lexeme string, id long").coalesce(2)
    rows = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "q int, lexeme string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(r) for r in match.best(own, rows, "q", 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {(q, i, n) for q, ws in asked.items() for n, i in [(-n, i) for n, i in sorted((-len(ws & d), i) for i, d in docs.items() if ws & d)[:3]]}
    assert got == want


def test_many_queries_hold_few_pairs(spark, tmp_path):
    """no aggregate holds the pairs of documents and queries; rows that share an id are one document."""
    assert "Aggregate" not in plan(queries.many_queries_top10(spark, DATA))
    os.symlink(f"{DATA}/benchmark.parquet", tmp_path / "benchmark.parquet")
    texts(spark, tmp_path, TWICE)
    df = queries.many_queries_top10(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    c.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(entries.oracle_sql()["many_queries_top10"]).fetchall())


def test_document_frequency_moves_words_alone(spark):
    """partial sums by word are shuffled, not each word of each document."""
    moved = re.findall(r"hashpartitioning\(([^)]*)\)", plan(queries.document_frequency(spark, DATA)))
    assert [[x.split("#")[0] for x in keys.split(", ")][0] for keys in moved] == ["lexeme", "id"] and "id#" not in moved[0]


@pytest.mark.parametrize("name", ["spelling_candidates", "trigram_similarity_pairs"])
def test_typed_words_meet_few_of_the_vocabulary(spark, name):
    """no pairs of all words with all typed ones."""
    assert "BroadcastNestedLoopJoin" not in plan(queries.QUERIES[name](spark, DATA))


def test_sharing_is_the_overlap_of_trigrams(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    typed = ["a", "ab", "abc", "écba", "aaaaaaa"]
    vocabulary = build.vocabulary(spark.createDataFrame([(w,) for w in words], "word string"))
    fold = str.maketrans("é", "e")
    for nearby in (False, True):
        got = {(r["word"], r["typed"]) for r in expand.sharing(vocabulary, typed, nearby).collect()}
        want = {(w, t) for w in words for t in typed if trigrams_text(w.translate(fold)) & trigrams_text(t.translate(fold)) and (not nearby or abs(len(w) - len(t)) <= expand.distance_allowed(t))}
        assert got == want
    assert expand.sharing(vocabulary, []).count() == 0


def test_pages_reach_python_few_at_a_time(spark, tmp_path):
    """batches of 100 rows, not of 10,000; pages beyond a million bytes stay whole, absent ones absent."""
    p = plan(queries.markup_strip(spark, DATA))
    assert "BatchEvalPython" in p and "ArrowEvalPython" not in p
    spark.createDataFrame([(1, "<p>" + "word " * 250_000 + "</p>"), (2, None), (3, "")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    same_as_sql(spark, str(tmp_path), "markup_strip")


def test_raw_searches_shuffle_hits_alone(spark):
    """F8, F9: tokens are grouped where they are; a condition on tags does not tokenize contents."""
    for name in ("stemmed_search_en", "simple_text_any_field"):
        assert "token#" not in "".join(x for x in plan(queries.QUERIES[name](spark, DATA)).split("\n") if "Exchange" in x)
    docs = corpus.documents(spark, DATA)
    assert "text#" not in plan(build.postings(docs, ["simple"], ("B",))).split("Scan")[1]
