"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from skein.llm.bpe import op5_byte_bpe
from skein.llm.decontaminate import op10_benchmark_decontamination
from skein.llm.licenses import op6_license_scan
from skein.llm.line_dedup import OP4_SQL, op4_line_dedup
from skein.llm.ngram_join import OP2_SQL, op2_ngram_jaccard
from skein.llm.quality import op8_quality
from skein.llm.sharding import op7_sharding
from skein.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from skein.llm.token_counts import op3_token_counts
from skein.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
SQL = {"op1_substring_dedup": OP1_SQL, "op2_ngram_jaccard": OP2_SQL, "op4_line_dedup": OP4_SQL, "op9_url_filter": OP9_SQL}
