"""Queries of this package, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .ann import op8_adaptive_dimension_scan
from .jaccard import op2_ngram_jaccard_join
from .licenses import op7_license_scan
from .mixing import op9_entropy_balancing
from .packing import op4_configuration_packing
from .quality import op5_attention_quality
from .sharding import op10_hypergeometric_sharding
from .tokencount import op3_transducer_token_counts
from .toxicity import op1_toxicity_gru
from .topk import OP6_SQL, op6_ball_tree_top_k

QUERIES = {
    "op1_toxicity_gru": op1_toxicity_gru,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_transducer_token_counts": op3_transducer_token_counts,
    "op4_configuration_packing": op4_configuration_packing,
    "op5_attention_quality": op5_attention_quality,
    "op6_ball_tree_top_k": op6_ball_tree_top_k,
    "op7_license_scan": op7_license_scan,
    "op8_adaptive_dimension_scan": op8_adaptive_dimension_scan,
    "op9_entropy_balancing": op9_entropy_balancing,
    "op10_hypergeometric_sharding": op10_hypergeometric_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op6_ball_tree_top_k": OP6_SQL,
}
