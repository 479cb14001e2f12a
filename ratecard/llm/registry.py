"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5_chat_format
from .collocations import OP13_SQL, op13_phrase_collocations
from .decontamination import op10_decontamination
from .embedding_dedup import op2_embedding_dedup
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .html_extraction import op12_html_extraction
from .jaccard_join import op4_ngram_jaccard_join
from .license_scan import OP9_SQL, op9_license_scan
from .lm_scoring import op1_lm_scoring
from .packing import op8_packing
from .token_output import op6_token_output
from .toxicity import op7_toxicity
from .url_filter import OP3_SQL, op3_url_filter


def queries() -> dict:
    own = (op1_lm_scoring, op2_embedding_dedup, op3_url_filter, op4_ngram_jaccard_join, op5_chat_format, op6_token_output, op7_toxicity, op8_packing, op9_license_scan, op10_decontamination, op11_fill_in_middle, op12_html_extraction, op13_phrase_collocations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op5_chat_format": OP5_SQL, "op9_license_scan": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
