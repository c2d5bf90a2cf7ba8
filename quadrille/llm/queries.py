"""The registered queries of this package and their SQL, by name."""

from __future__ import annotations

from quadrille.llm.ann import op3_ann
from quadrille.llm.html_text import op10_html_text
from quadrille.llm.line_dedup import OP7_SQL, op7_line_dedup
from quadrille.llm.lm_score import op8_lm_score
from quadrille.llm.order_minhash import op11_order_minhash
from quadrille.llm.packing import op9_packing
from quadrille.llm.prefix_trie import op12_prefix_trie
from quadrille.llm.quality import OP6_SQL, op6_quality
from quadrille.llm.secrets import op4_secrets
from quadrille.llm.sentencepiece_bpe import op2_sentencepiece
from quadrille.llm.simhash import op5_simhash
from quadrille.llm.spelling import op13_spelling
from quadrille.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_ann": op3_ann,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_packing": op9_packing,
    "op10_html_text": op10_html_text,
    "op11_order_minhash": op11_order_minhash,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op6_quality": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
}
