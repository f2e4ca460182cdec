"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineupkit.llm.conversation_repair import OP11_SQL, op11_earley_repair
from lineupkit.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from lineupkit.llm.jaccard_join import OP6_SQL, op6_ngram_jaccard
from lineupkit.llm.language_id import op4_byte_cnn
from lineupkit.llm.line_dedup import OP8_SQL, op8_line_dedup
from lineupkit.llm.mixing import op3_mix_quotas
from lineupkit.llm.packing import op9_pack_tiers
from lineupkit.llm.pii import op7_surrogates
from lineupkit.llm.quality_rules import op12_rule_ensemble
from lineupkit.llm.token_counts import op5_prefix_counts
from lineupkit.llm.token_files import op2_token_wavelet
from lineupkit.llm.vector_dedup import OP1_SQL, op1_hnsw_dedup
from lineupkit.llm.vector_search import op10_rp_forest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw_dedup": op1_hnsw_dedup,
    "op2_token_wavelet": op2_token_wavelet,
    "op3_mix_quotas": op3_mix_quotas,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_prefix_counts": op5_prefix_counts,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_surrogates": op7_surrogates,
    "op8_line_dedup": op8_line_dedup,
    "op9_pack_tiers": op9_pack_tiers,
    "op10_rp_forest": op10_rp_forest,
    "op11_earley_repair": op11_earley_repair,
    "op12_rule_ensemble": op12_rule_ensemble,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {"op1_hnsw_dedup": OP1_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_line_dedup": OP8_SQL, "op11_earley_repair": OP11_SQL, "op13_hard_negatives": OP13_SQL}
