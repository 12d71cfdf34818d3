"""The queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from auditlake.llm.op01_warc import OP1_SQL, op1_warc
from auditlake.llm.op02_decontamination import op2_decontamination
from auditlake.llm.op03_exact_dedup import OP3_SQL, op3_exact_dedup
from auditlake.llm.op04_language import op4_language
from auditlake.llm.op05_sharding import op5_sharding
from auditlake.llm.op06_quality import op6_quality
from auditlake.llm.op07_toxicity import op7_toxicity
from auditlake.llm.op08_jaccard_join import op8_jaccard_join
from auditlake.llm.op09_pieces import op9_pieces
from auditlake.llm.op10_pitman_yor import op10_pitman_yor
from auditlake.llm.op11_spelling import OP11_SQL, op11_spelling
from auditlake.llm.op12_ranking import OP12_SQL, op12_ranking
from auditlake.llm.op13_neighbours import op13_neighbours

QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language": op4_language,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_pieces": op9_pieces,
    "op10_pitman_yor": op10_pitman_yor,
    "op11_spelling": op11_spelling,
    "op12_ranking": op12_ranking,
    "op13_neighbours": op13_neighbours,
}
ORACLES = {"op1_warc": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op11_spelling": OP11_SQL, "op12_ranking": OP12_SQL}
