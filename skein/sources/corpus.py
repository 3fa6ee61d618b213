"""The example tables as index rows (columns of model.DOCUMENT), all in the JVM but for the text of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.sources.extract import page_text

EPOCH = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(df: DataFrame, provider: str, **columns) -> DataFrame:
    own = {
        "links": F.array().cast("array<string>"), "tags": F.array().cast("array<string>"), "metatags": F.array().cast("array<string>"), "subtags": F.array().cast("array<string>"),
        "parts": F.create_map().cast("map<string,string>"), "parts_text": F.lit(""), "source": F.lit(""), "info": F.lit("{}"), "config": F.lit("simple"),
    } | columns
    own["tags_text"] = F.array_join(F.concat(own["tags"], own["metatags"]), " ")
    own["title_search"] = T.lower(own["title"])
    return df.select(F.lit(provider).alias("provider_id"), *[c.alias(n) for n, c in own.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned by their source, shared with everyone for every third id and with one of seven groups."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    everyone = F.when(i % 3 == 0, F.array(F.lit("u:__all"))).otherwise(F.array().cast("array<string>"))
    return _row(
        d, "documents", id=i, document_id=i.cast("string"), owner_id=F.col("source"), source=F.col("source"),
        title=F.concat_ws("_", "source", "lang", F.concat(i.cast("string"), F.lit(".txt"))), content=F.col("text"),
        access=F.concat(F.array(F.concat(F.lit("u:"), F.col("source"))), everyone, F.array(F.concat(F.lit("g:g"), (i % 7).cast("string")))),
        metatags=F.array("lang"), subtags=F.array(F.concat(F.lit("lang_"), F.col("lang"))), modified_time=F.lit(EPOCH) + i,
    )


def with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents() with info: n_chars, lang, and quality and toxic where labelled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    joined = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    info = joined.select(F.col("doc_id").alias("id"), F.to_json(F.struct("n_chars", "lang", "quality", (F.col("toxic") == 1).alias("toxic"))).alias("info"))
    return documents(spark, sf_dir).drop("info").join(info, "id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages")
    return _row(d, "pages", id=F.col("page_id"), document_id=F.col("page_id").cast("string"), owner_id=F.lit("web"), title=F.col("url"), content=page_text(F.col("html")), access=F.array(F.lit("u:__all")), modified_time=F.lit(EPOCH) + F.col("page_id"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return _row(d, "conversations", id=F.col("conv_id") * 1_000_000 + F.col("turn"), document_id=key, owner_id=F.col("role"), title=F.col("role"), content=F.col("text"), access=F.array(F.concat(F.lit("u:"), F.col("role"))), metatags=F.array("role"), modified_time=F.lit(EPOCH) + F.col("turn"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    return _row(d, "parts", id=F.col("p_partkey"), document_id=F.col("p_partkey").cast("string"), owner_id=F.col("p_brand"), title=F.col("p_name"), content=F.lit(""), access=F.array(F.lit("u:__all")), modified_time=F.lit(EPOCH) + F.col("p_partkey"))
