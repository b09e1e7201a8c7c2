"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .chat_preference import OP1_SQL, op1_chat_preference
from .decontamination import OP5_SQL, op5_decontamination
from .dual_tree_lloyd import OP13_SQL, op13_dual_tree_lloyd
from .html_extraction import op2_html_extraction
from .language_crf import op11_language_crf
from .ngram_jaccard import op6_ngram_jaccard
from .packing import op9_length_packing
from .pii import op3_pii
from .quality_fm import op8_quality_fm
from .token_alignment import op12_token_alignment
from .token_records import op10_token_records
from .topk_search import OP4_SQL, op4_topk_search
from .url_filter import op7_url_filter

QUERIES = {
    "op1_chat_preference": op1_chat_preference,
    "op2_html_extraction": op2_html_extraction,
    "op3_pii": op3_pii,
    "op4_topk_search": op4_topk_search,
    "op5_decontamination": op5_decontamination,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_url_filter": op7_url_filter,
    "op8_quality_fm": op8_quality_fm,
    "op9_length_packing": op9_length_packing,
    "op10_token_records": op10_token_records,
    "op11_language_crf": op11_language_crf,
    "op12_token_alignment": op12_token_alignment,
    "op13_dual_tree_lloyd": op13_dual_tree_lloyd,
}

SQL = {
    "op1_chat_preference": OP1_SQL,
    "op4_topk_search": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op13_dual_tree_lloyd": OP13_SQL,
}
