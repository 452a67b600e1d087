"""Registered queries of the training-text operators, and SQL for those that SQL can express."""

from .chat import op2_chat
from .fill_middle import op13_fill_middle
from .filter_audit import ORACLE_SQL as AUDIT_SQL
from .filter_audit import op12_filter_audit
from .html_text import op10_main_text
from .language import op5_language
from .media import op8_media
from .packing import op1_pack
from .pii import op4_pii
from .pieces import op9_pieces
from .search import ORACLE_SQL as TOP_K_SQL
from .search import op6_top_k
from .simhash import op3_simhash
from .token_counts import op11_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    "op1_pack": op1_pack,
    "op2_chat": op2_chat,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_language": op5_language,
    "op6_top_k": op6_top_k,
    "op7_toxicity": op7_toxicity,
    "op8_media": op8_media,
    "op9_pieces": op9_pieces,
    "op10_main_text": op10_main_text,
    "op11_token_counts": op11_token_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {"op6_top_k": TOP_K_SQL, "op12_filter_audit": AUDIT_SQL}
