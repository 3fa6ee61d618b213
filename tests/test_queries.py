"""Example queries against DuckDB, the entry points, and streaming."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from helpers import ME, doc, frame, ids

import __spark_entry__ as entries
from skein.model import INCOMING
from skein.plans import queries
from skein.plans.engine import Engine
from skein.streaming.ingest import changes, ingest

DATA = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(v, 6) if isinstance(v, float) else v


#: What SQL can't express; tests/test_functions.py, test_engine.py and test_extract.py hold these operators against values worked out by hand.
NO_SQL = {"excerpt_page"}
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())
    if name in SQL:
        want = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
        assert got == sorted(repr([plain(x) for x in r]) for r in want)
    else:
        assert got and name in NO_SQL


def test_entry(spark):
    assert entries.entry(spark).count() > 0
    assert set(entries.oracle_sql()) <= set(entries.queries())


def test_without_optional_part(tmp_path):
    """The rest imports without the folders of the training-data operators."""
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_filters_are_pushed_down(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index(frame(spark, [doc("a", "t", "apple")]), now=1)
    plan = e.store.table("postings").where("lexeme = 'apple' AND weight = 'D'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lexeme,apple)" in plan and "positions" not in plan.split("ReadSchema")[1]


def test_stream(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    e.initialize()
    source = str(tmp_path / "in")

    def add(rows):
        fields = [x.split()[0] for x in INCOMING.split(", ")] + ["arrived", "deleted"]
        spark.createDataFrame([tuple(d.get(f) for f in fields) for d in rows], INCOMING + ", arrived bigint, deleted boolean").write.mode("append").parquet(source)

    add([doc("a", "", "apple", arrived=1), doc("a", "", "avocado", arrived=2), doc("b", "", "banana", arrived=1)])
    for _ in range(2):  # a second run over the same files changes nothing
        ingest(changes(spark, source), e, str(tmp_path / "c")).awaitTermination(120)
    assert ids(e, "avocado", ME) == ["a"] and ids(e, "apple", ME) == [] and ids(e, "banana", ME) == ["b"]
    add([doc("b", arrived=3, deleted=True), doc("c", "", "cherry", arrived=4)])
    ingest(changes(spark, source), e, str(tmp_path / "c")).awaitTermination(120)
    assert ids(e, "banana", ME) == [] and ids(e, "cherry", ME) == ["c"]
