"""Queries of the llm operators and, where SQL can say them, their oracles."""

from matchbook.llm.decontaminate import OP4_SQL, op4_decontaminate
from matchbook.llm.html_text import op2_main_text
from matchbook.llm.jaccard_join import OP8_SQL, op8_jaccard
from matchbook.llm.language_id import op12_language
from matchbook.llm.lexical_search import OP13_SQL, op13_search
from matchbook.llm.minhash import NEAR_SQL, near_text_classes, op10_fingerprints
from matchbook.llm.mixing import op6_mix
from matchbook.llm.pii import op9_pii
from matchbook.llm.quality import op3_quality
from matchbook.llm.secret_scan import OP7_SQL, op7_secrets
from matchbook.llm.toxicity import op1_toxicity
from matchbook.llm.url_filter import OP5_SQL, op5_url_filter
from matchbook.llm.whitening import op11_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_main_text": op2_main_text,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_mix": op6_mix,
    "op7_secrets": op7_secrets,
    "op8_jaccard": op8_jaccard,
    "op9_pii": op9_pii,
    "op10_fingerprints": op10_fingerprints,
    "op11_whitening": op11_whitening,
    "op12_language": op12_language,
    "op13_search": op13_search,
    "near_text_classes": near_text_classes,        # the band join of the operator of op10
}
ORACLES = {
    "op4_decontaminate": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_secrets": OP7_SQL,
    "op8_jaccard": OP8_SQL,
    "op13_search": OP13_SQL,
    "near_text_classes": NEAR_SQL,
}
