"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.access import Access
from skein.model import SearchRequest
from skein.plans import queries
from skein.plans.engine import Engine, with_settings
from skein.settings import Settings

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Searches over a built index: one rare word, one in most documents, two and three words, a common and a rarer one.
SEARCHES = {"search_rare": "licensed", "search_frequent": "the", "search_two": "erst inth", "search_three": "erst inth reat", "search_common_multi": "the erst", "search_phrase": '"of the"'}
#: Stop words of the index among other words.
SEARCHES["search_stop_words"] = "the erst and inth"
#: A word that only another's PRIVATE documents have, and one far inside LONG documents of nearly a megabyte.
PRIVATE, LONG = 5000, 20
EXTRA_SEARCHES = {"search_private": "zqprivate", "search_excerpt": "zqneedle"}
QUERIES = ("rank_idf_two_terms", "document_frequency", "build_postings", "vocabulary_words", "many_queries_top10", "upsert_partial", "simple_int", "phrase_adjacent")


def timed(f, runs: int = 3) -> float:
    times = []
    for _ in range(runs):
        began = time.time()
        f()
        times.append(time.time() - began)
    return round(statistics.median(times), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    for name in QUERIES:
        out[name] = timed(lambda name=name: queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save(), 2)
    folder = tempfile.mkdtemp()
    try:
        engine = Engine(spark, f"{folder}/index", Settings(language="english,french,german,spanish", search_timeout=0))
        incoming = queries._incoming(spark, SF_DIR).withColumn("users", F.array(F.lit("__all")))
        out["index_documents"] = timed(lambda: engine.index(incoming, now=0), 1)
        out["rebuild_vocabulary"] = timed(engine.rebuild_vocabulary, 1)
        viewer = Access(viewer="reader")
        for name, text in SEARCHES.items():
            out[name] = timed(lambda text=text: engine.search(SearchRequest(text, provider="documents"), viewer))
        first = incoming.orderBy("modified_time")
        private = first.limit(PRIVATE).withColumns({"document_id": F.concat(F.lit("p"), "document_id"), "owner": F.lit("other"), "users": F.array(F.lit("other")), "content": F.concat(F.lit("zqprivate "), F.substring("content", 1, 300))})
        long = first.limit(LONG).withColumns({"document_id": F.concat(F.lit("l"), "document_id"), "content": F.concat(F.expr("repeat('padding ', 120000)"), F.lit("zqneedle "), F.substring("content", 1, 4000))})
        with_settings(engine, max_content_size=1_000_000).index(private.unionByName(long), now=0)
        for name, text in EXTRA_SEARCHES.items():
            found = engine.search(SearchRequest(text, provider="documents"), viewer)
            assert found.total == (LONG if name == "search_excerpt" else 0), (name, found.total)
            out[name] = timed(lambda text=text: engine.search(SearchRequest(text, provider="documents"), viewer))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of the headline queries, median of runs", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    sys.exit(main())
