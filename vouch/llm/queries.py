"""The registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from vouch.llm.alignment import op13_lockstep_alignment
from vouch.llm.decontamination import op12_wu_manber
from vouch.llm.lm import op1_bloom_lm
from vouch.llm.media import op3_media_columns
from vouch.llm.mixing import OP8_SQL, op8_systematic_mix
from vouch.llm.periods import op11_periodic_runs
from vouch.llm.pieces import op7_max_plus_pieces
from vouch.llm.pii import op2_personal_data
from vouch.llm.repeats import op4_run_index
from vouch.llm.simhash import op9_ball_hashing
from vouch.llm.toxicity import op6_toxicity_cnn
from vouch.llm.url_rules import OP10_SQL, op10_url_rules
from vouch.llm.vectors import op5_pca_tiles

QUERIES = {
    "op1_bloom_lm": op1_bloom_lm,
    "op2_personal_data": op2_personal_data,
    "op3_media_columns": op3_media_columns,
    "op4_run_index": op4_run_index,
    "op5_pca_tiles": op5_pca_tiles,
    "op6_toxicity_cnn": op6_toxicity_cnn,
    "op7_max_plus_pieces": op7_max_plus_pieces,
    "op8_systematic_mix": op8_systematic_mix,
    "op9_ball_hashing": op9_ball_hashing,
    "op10_url_rules": op10_url_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_wu_manber": op12_wu_manber,
    "op13_lockstep_alignment": op13_lockstep_alignment,
}
ORACLES = {"op8_systematic_mix": OP8_SQL, "op10_url_rules": OP10_SQL}
