"""Queries of the corpus operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5_chat_format
from .decontamination import OP8_SQL, op8_decontamination
from .language_id import op9_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .mixing import OP10_SQL, op10_mixing
from .simhash import op2_simhash
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .token_counts import op1_token_counts
from .topk_search import OP7_SQL, op7_topk_search
from .toxicity import op6_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_topk_search": op7_topk_search,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op3_line_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op7_topk_search": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_mixing": OP10_SQL,
}
