"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import hmm, html, langid, packing, pieces, quality, simhash, tokenfile, topk, warc

QUERIES = {
    "op1_simhash_anchor_cover": simhash.op1,
    "op2_token_range_coder": tokenfile.op2,
    "op3_sentencepiece_viterbi": pieces.op3,
    "op4_quality_mcd": quality.op4,
    "op5_warc_revisits": warc.op5,
    "op6_langid_kneser_ney": langid.op6,
    "op7_hmm_scores": hmm.op7,
    "op8_topk_uniform_threshold": topk.op8,
    "op9_html_boosted_trees": html.op9,
    "op10_packing_nnls": packing.op10,
}
SQL = {"op5_warc_revisits": warc.SQL5, "op8_topk_uniform_threshold": topk.SQL8}
