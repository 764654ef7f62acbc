"""The queries of this package, and the SQL for those that SQL can express."""

from __future__ import annotations

from .counts import op7_viterbi_token_counts
from .decisionlist import op13_decision_list_quality
from .decontaminate import OP9_SQL, op9_template_decontamination
from .embeddings import op10_cap_filter_near_dedup
from .language import op4_byte_network_language
from .linededup import OP6_SQL, op6_line_dedup
from .mixing import op8_pivotal_mix
from .quality import op2_rule_ensemble_quality
from .sharding import OP1_SQL, op1_byte_shards
from .simhash import op3_simhash_near_dedup
from .spelling import OP11_SQL, op11_spelling_variants
from .tokenfile import op5_rans_tokens
from .whitening import op12_tiled_whitening

QUERIES = {
    "op1_byte_shards": op1_byte_shards,
    "op2_rule_ensemble_quality": op2_rule_ensemble_quality,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_byte_network_language": op4_byte_network_language,
    "op5_rans_tokens": op5_rans_tokens,
    "op6_line_dedup": op6_line_dedup,
    "op7_viterbi_token_counts": op7_viterbi_token_counts,
    "op8_pivotal_mix": op8_pivotal_mix,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_cap_filter_near_dedup": op10_cap_filter_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_tiled_whitening": op12_tiled_whitening,
    "op13_decision_list_quality": op13_decision_list_quality,
}

ORACLES = {
    "op1_byte_shards": OP1_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_template_decontamination": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
}
