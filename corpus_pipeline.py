"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.bpe import encode
from skein.llm.common import checkpoint, table
from skein.llm.decontaminate import drop_contaminated
from skein.llm.line_dedup import dedup_lines
from skein.llm.ngram_join import keep_one
from skein.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that an earlier document has, or that came before in it, are cut from the text."""
    return dedup_lines(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, five words and a similarity of 0.8, the document with the least doc_id stays."""
    return keep_one(docs, 5, 80, 100)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: doc_id, n_tokens and the digests of ids and of what they decode to."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("benchmark", benchmark_stage), ("encoding", encoding_stage)]
#: Minimum-covariance estimates, SimHash and BPE are beyond SQL; tests hold run() against plain versions of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what a stage leaves is checkpointed, as later stages read it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
