"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from dbgauge.llm.chat import op7_chat
from dbgauge.llm.decontaminate import OP5_SQL, op5_decontaminate
from dbgauge.llm.fim import OP11_SQL, op11_fill_in_middle
from dbgauge.llm.langid import op8_language_id
from dbgauge.llm.linededup import OP1_SQL, op1_line_dedup
from dbgauge.llm.mixing import op10_mixing
from dbgauge.llm.pieces import op13_sentencepiece
from dbgauge.llm.simhash import op3_simhash
from dbgauge.llm.sketches import op2_fingerprints
from dbgauge.llm.spelling import op12_spelling
from dbgauge.llm.suffixes import op6_suffix_dedup
from dbgauge.llm.toxicity import op4_toxicity
from dbgauge.llm.warc import op9_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat": op7_chat,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling": op12_spelling,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLES = {"op1_line_dedup": OP1_SQL, "op5_decontaminate": OP5_SQL, "op11_fill_in_middle": OP11_SQL}
