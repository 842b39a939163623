"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from casemill.llm.chat_format import OP13_SQL, op13
from casemill.llm.decontaminate import op3
from casemill.llm.embedding_dedup import op10
from casemill.llm.hard_negatives import OP12_SQL, op12
from casemill.llm.jaccard_join import OP2_SQL, op2
from casemill.llm.line_dedup import OP4_SQL, op4
from casemill.llm.lm_score import op1
from casemill.llm.mixing import op5
from casemill.llm.periodic_runs import op11
from casemill.llm.quality import op8
from casemill.llm.secret_scan import op7
from casemill.llm.substring_dedup import OP9_SQL, op9
from casemill.llm.suffix_dedup import op6

QUERIES = {
    "op1_lm_score": op1,
    "op2_jaccard_join": op2,
    "op3_decontaminate": op3,
    "op4_line_dedup": op4,
    "op5_mix_sources": op5,
    "op6_suffix_array_dedup": op6,
    "op7_secret_scan": op7,
    "op8_quality": op8,
    "op9_substring_dedup": op9,
    "op10_embedding_dedup": op10,
    "op11_periodic_runs": op11,
    "op12_hard_negatives": op12,
    "op13_chat_format": op13,
}

SQL: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op4_line_dedup": OP4_SQL, "op9_substring_dedup": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_chat_format": OP13_SQL}
