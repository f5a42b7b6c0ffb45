"""Queries of this subpackage for the registry, and SQL where SQL can express them."""

from __future__ import annotations

from sparkloom.llm.bpe_codec import op8_bpe_codec
from sparkloom.llm.host_suffix import op5_html_main_text
from sparkloom.llm.jaccard_join import op2_ngram_jaccard
from sparkloom.llm.langid import op4_language_id
from sparkloom.llm.mixing import op9_mixing
from sparkloom.llm.one_bit_search import OP6_SQL, op6_one_bit_search
from sparkloom.llm.periodic_runs import op12_periodic_runs
from sparkloom.llm.phrases import OP11_SQL, op11_phrases
from sparkloom.llm.pii import op10_pii
from sparkloom.llm.pq_dedup import OP7_SQL, op7_pq_dedup
from sparkloom.llm.quality import op13_quality
from sparkloom.llm.token_counts import op1_token_counts
from sparkloom.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_html_main_text": op5_html_main_text,
    "op6_one_bit_search": op6_one_bit_search,
    "op7_pq_dedup": op7_pq_dedup,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_phrases": op11_phrases,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {"op6_one_bit_search": OP6_SQL, "op7_pq_dedup": OP7_SQL, "op11_phrases": OP11_SQL}
