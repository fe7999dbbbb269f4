"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from . import ann, compress, decontaminate, exact_topk, hard_negatives, jaccard, langid, line_dedup, lm, mixing, pii, sentencepiece_codec, sharding

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_sharding": sharding.op2_sharding,
    "op3_exact_topk": exact_topk.op3_exact_topk,
    "op4_mixing": mixing.op4_mixing,
    "op5_pii": pii.op5_pii,
    "op6_ann": ann.op6_ann,
    "op7_language_id": langid.op7_language_id,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_lm_score": lm.op9_lm_score,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_compress": compress.op13_compress,
}
SQL = {
    "op2_sharding": sharding.OP2_SQL,
    "op3_exact_topk": exact_topk.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_ann": ann.OP6_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op10_ngram_jaccard": jaccard.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_decontaminate": decontaminate.OP12_SQL,
    "op13_compress": compress.OP13_SQL,
}
