"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .queries_01 import ORACLE_1, op1_quality_rules
from .queries_02 import op2_byte_bpe
from .queries_03 import op3_html_text
from .queries_04 import op4_simhash
from .queries_05 import ORACLE_5, op5_warc
from .queries_06 import op6_bin_completion
from .queries_07 import ORACLE_7, op7_rp_forest
from .queries_08 import op8_toxicity
from .queries_09 import op9_pii
from .queries_10 import ORACLE_10, op10_chat_format
from .queries_11 import ORACLE_11, op11_source_divergence
from .queries_12 import ORACLE_12, op12_hard_negatives
from .queries_13 import op13_sharding

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_text": op3_html_text,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_bin_completion": op6_bin_completion,
    "op7_rp_forest": op7_rp_forest,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_chat_format": op10_chat_format,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sharding": op13_sharding,
}
ORACLES = {
    "op1_quality_rules": ORACLE_1,
    "op5_warc": ORACLE_5,
    "op7_rp_forest": ORACLE_7,
    "op10_chat_format": ORACLE_10,
    "op11_source_divergence": ORACLE_11,
    "op12_hard_negatives": ORACLE_12,
}
