"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm.embeddings import OP3_SQL, op3_embedding_dedup
from quire.llm.filter_audit import OP13_SQL, op13_filter_audit
from quire.llm.jaccard import OP4_SQL, op4_jaccard_join
from quire.llm.language import op7_language_id
from quire.llm.line_dedup import OP9_SQL, op9_line_dedup
from quire.llm.mixing import OP2_SQL, op2_mixing
from quire.llm.packing import op10_packing
from quire.llm.quality import op1_quality_rules
from quire.llm.substring_dedup import OP12_SQL, op12_substring_dedup
from quire.llm.tokenfiles import op6_token_files, op8_token_counts
from quire.llm.toxicity import op5_toxicity
from quire.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op2_mixing": OP2_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op9_line_dedup": OP9_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
