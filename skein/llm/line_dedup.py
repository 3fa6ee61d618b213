"""Operator 4, line dedup: content-defined chunks of lines; a chunk that another document has first is removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import checkpoint, table

#: A boundary depends on this many lines, so that an insertion moves no boundary beyond them.
ROLL = 2
#: One boundary in so many lines, on average.
SPREAD = 4


def with_chunks(docs: DataFrame, roll: int = ROLL, spread: int = SPREAD) -> DataFrame:
    """docs with d_lines and d_chunks: structs (k, start, n, key) of 0-based line runs, key the MD5 of the run's bytes.

    Line i ends a chunk if the rolling hash over the hashes of lines i - roll + 1 to i is 0 modulo spread,
    or if it is the last. The rolling hash is the first 32 bits of an MD5 over the lines' MD5 sums.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("d_lines", F.split(text, "\n"))
    docs = docs.withColumn("d_sums", F.transform("d_lines", lambda x: F.md5(x)))
    sums = F.col("d_sums")
    rolled = F.transform("d_sums", lambda x, i: F.conv(F.substring(F.md5(F.concat_ws("", *[F.coalesce(F.get(sums, i - j), F.lit("")) if j else x for j in range(roll - 1, -1, -1)])), 1, 8), 16, 10).cast("long"))
    # get() with a negative index gives null, so the first lines roll over fewer.
    docs = docs.withColumn("d_roll", rolled)
    last = F.size("d_lines") - 1
    ends = F.filter(F.transform("d_roll", lambda x, i: F.when((x % spread == 0) | (i == last), i)), lambda i: i.isNotNull())
    docs = docs.withColumn("d_ends", ends)
    lines, e = F.col("d_lines"), F.col("d_ends")

    # Two mentions of d_lines keep the optimiser from splitting the text again for every chunk.
    def chunk(end, k):
        start = F.when(k > 0, F.get(e, k - 1) + 1).otherwise(F.lit(0))
        return F.struct(k.alias("k"), start.alias("start"), (end - start + 1).alias("n"), F.md5(F.array_join(F.slice(lines, start + 1, F.least(end - start + 1, F.size(lines))), "\n")).alias("key"))

    return docs.withColumn("d_chunks", F.transform("d_ends", chunk)).drop("d_sums", "d_roll", "d_ends")


def dedup_lines(docs: DataFrame, roll: int = ROLL, spread: int = SPREAD) -> DataFrame:
    """docs with text replaced and n_lines, n_chunks, n_removed_lines added: repeated multi-line chunks are cut.

    Of the chunks of two or more lines with the same bytes, the first by (doc_id, place) stays and the
    others go. Candidates share an MD5; a chunk goes only after its bytes are compared with those of the
    first. A chunk of blank lines alone stays. Null text stays null; a row with null doc_id neither loses
    chunks nor is a first; rows with the same doc_id and text are each cut by the same places. Columns of
    docs stay; those named n_lines, n_chunks or n_removed_lines are replaced. Text leaves a row twice:
    once for the first copies' bytes, once to bring each document the places to cut.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_chunks", "n_removed_lines")]
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    chunked = with_chunks(slim, roll, spread).select("doc_id", F.xxhash64("text").alias("text_key"), F.explode_outer("d_chunks").alias("c")).where("c.n >= 2")  # explode() would push a filter that chunks every text again
    places = chunked.select("doc_id", "text_key", "c.k", "c.start", "c.n", "c.key")
    firsts = places.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "k", "start", "n")).alias("first")).where("times > 1")
    # Written out, so that the joins below have it as a plain input: only then are chunks that very many documents have dealt out anew.
    firsts = checkpoint(firsts)
    # The bytes of each first copy, read from its own document.
    wanted = firsts.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), F.struct("key", F.col("first.start").alias("start"), F.col("first.n").alias("n")).alias("w"))
    wanted = wanted.groupBy("doc_id", "text_key").agg(F.collect_list("w").alias("ws"))  # of one document: no more than it has chunks
    keyed = slim.withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"])
    sources = keyed.join(wanted, ["doc_id", "text_key"]).select(F.split("text", "\n").alias("lines"), "ws").select("lines", F.explode_outer("ws").alias("w"))
    sources = sources.select(F.col("w.key").alias("key"), F.array_join(F.slice("lines", F.col("w.start") + 1, F.col("w.n")), "\n").alias("first_bytes"))
    others = places.join(firsts.select("key", "first"), "key").where("struct(doc_id, text_key, k) <> struct(first.doc_id, first.text_key, first.k)")
    cuts = others.join(sources, "key").where(F.trim(F.regexp_replace("first_bytes", r"\s+", " ")) != "")
    cuts = cuts.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("k", "start", "n", "first_bytes")).alias("d_cuts"))
    # The caller's other columns travel as one struct, so no name of theirs meets one used here.
    text = F.col("text").cast("string")
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != "text"]).alias("own"), "doc_id", text.alias("text"), F.xxhash64(text).alias("d_key"))
    cuts = cuts.select(F.col("doc_id").alias("d_doc"), F.col("text_key").alias("d_text_key"), "d_cuts")
    joined = full.join(cuts, (F.col("doc_id") == F.col("d_doc")) & (F.col("d_key") == F.col("d_text_key")), "left")
    joined = with_chunks(joined, roll, spread)
    lines = F.col("d_lines")
    confirmed = F.transform(F.filter(F.coalesce("d_cuts", F.array()), lambda c: F.array_join(F.slice(lines, c["start"] + 1, c["n"]), "\n") == c["first_bytes"]), lambda c: c["k"])
    joined = joined.withColumn("d_gone", F.when(F.col("d_cuts").isNotNull(), confirmed).otherwise(F.array().cast("array<int>")))
    gone = F.col("d_gone")
    kept = F.filter("d_chunks", lambda c: ~F.array_contains(gone, c["k"]))
    joined = joined.withColumn("d_kept", kept)
    text = F.array_join(F.flatten(F.transform("d_kept", lambda c: F.slice(lines, c["start"] + 1, c["n"]))), "\n")
    n_kept = F.aggregate("d_kept", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    out = joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("d_lines")).cast("long"),
        "n_chunks": F.when(F.col("text").isNull(), 0).otherwise(F.size("d_chunks")).cast("long"),
        "n_removed_lines": (F.size("d_lines") - n_kept).cast("long"),
        "d_text": F.when(F.size("d_gone") > 0, text).otherwise(F.col("text")),
    })
    return out.select(*[F.col("d_text").alias("text") if c == "text" else F.col("own").getField(c).alias(c) for c in own], "n_lines", "n_chunks", "n_removed_lines")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, ls, list_transform(ls, lambda x: md5(x)) AS ms FROM l),
r AS (SELECT doc_id, i, ls[i] AS line, i = len(ls) OR ('0x' || substr(md5(CASE WHEN i > 1 THEN ms[i - 1] ELSE '' END || ms[i]), 1, 8))::BIGINT % 4 = 0 AS ends
  FROM (SELECT doc_id, ls, ms, unnest(range(1, len(ls) + 1)) AS i FROM s)),
k AS (SELECT doc_id, i, line, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes FROM k GROUP BY doc_id, k),
f AS (SELECT *, n >= 2 AND regexp_matches(bytes, '\S') AND row_number() OVER (PARTITION BY bytes, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM c),
o AS (SELECT doc_id, sum(n) AS n_lines, count(*) AS n_chunks, sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed_lines,
  sha256(coalesce(string_agg(bytes, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
