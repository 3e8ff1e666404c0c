"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lexarium.llm.byte_bpe import op4_byte_bpe
from lexarium.llm.decontamination import ORACLE as DECONTAMINATION_SQL
from lexarium.llm.decontamination import op5_decontamination
from lexarium.llm.fingerprints import op9_fingerprints
from lexarium.llm.hard_negatives import ORACLE as HARD_NEGATIVES_SQL
from lexarium.llm.hard_negatives import op12_hard_negatives
from lexarium.llm.html_text import op8_html_text
from lexarium.llm.language_id import op11_language_id
from lexarium.llm.licenses import op2_licenses
from lexarium.llm.licenses import oracle as licenses_sql
from lexarium.llm.line_dedup import ORACLE as LINE_DEDUP_SQL
from lexarium.llm.line_dedup import op7_line_dedup
from lexarium.llm.ppm import op6_ppm
from lexarium.llm.sharding import op10_sharding
from lexarium.llm.shingle_join import ORACLE as SHINGLE_JOIN_SQL
from lexarium.llm.shingle_join import op3_shingle_join
from lexarium.llm.toxicity import op1_toxicity
from lexarium.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_licenses, op3_shingle_join, op4_byte_bpe, op5_decontamination, op6_ppm, op7_line_dedup, op8_html_text, op9_fingerprints, op10_sharding, op11_language_id, op12_hard_negatives, op13_whitening)
}
ORACLE_SQL = {"op2_licenses": licenses_sql(), "op3_shingle_join": SHINGLE_JOIN_SQL, "op5_decontamination": DECONTAMINATION_SQL, "op7_line_dedup": LINE_DEDUP_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
