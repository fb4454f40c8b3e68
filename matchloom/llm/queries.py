"""The numbered queries, with SQL where SQL can express them."""

from __future__ import annotations

from matchloom.llm import bpe, embedding_dedup, fill_in_middle, hamming_search, html_text, licenses, lm, minhash, mixing, secrets, token_alignment, toxicity, urls

QUERIES = {
    "op1_hnsw": embedding_dedup.op1_hnsw,
    "op2_html_text": html_text.op2_html_text,
    "op3_mixing": mixing.op3_mixing,
    "op4_log_bilinear": lm.op4_log_bilinear,
    "op5_bpe": bpe.op5_bpe,
    "op6_secrets": secrets.op6_secrets,
    "op7_url_filter": urls.op7_url_filter,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_hamming": hamming_search.op9_hamming,
    "op10_minhash": minhash.op10_minhash,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_licenses": licenses.op13_licenses,
}
SQL = {"op7_url_filter": urls.SQL, "op11_fill_in_middle": fill_in_middle.SQL}
