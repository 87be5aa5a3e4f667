"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from folioscope.llm.html_crf import op10_html_crf
from folioscope.llm.mixing import op9_mix_pivotal
from folioscope.llm.packing import op6_pack_binary
from folioscope.llm.quality_cnn import op2_quality_cnn
from folioscope.llm.quality_rules import OP5_SQL, op5_line_rules
from folioscope.llm.simhash import op8_simhash_pigeonring
from folioscope.llm.suffix_dedup import op7_suffix_dedup
from folioscope.llm.topk_search import op4_bm25_wand
from folioscope.llm.warc import op3_warc_zip
from folioscope.llm.window_dedup import OP1_SQL, op1_window_dedup

QUERIES = {
    "op1_window_dedup": op1_window_dedup,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_warc_zip": op3_warc_zip,
    "op4_bm25_wand": op4_bm25_wand,
    "op5_line_rules": op5_line_rules,
    "op6_pack_binary": op6_pack_binary,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash_pigeonring": op8_simhash_pigeonring,
    "op9_mix_pivotal": op9_mix_pivotal,
    "op10_html_crf": op10_html_crf,
}
ORACLES = {"op1_window_dedup": OP1_SQL, "op5_line_rules": OP5_SQL}
