"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from reviewlab.llm import ann, lexical, lm, minhash, mixing, negatives, packing, pii, quality, simhash, suffix, topk, toxicity

QUERIES = {
    "op1_suffix": suffix.op1_suffix,
    "op2_ann": ann.op2_ann,
    "op3_quality": quality.op3_quality,
    "op4_top_k": topk.op4_top_k,
    "op5_minhash": minhash.op5_minhash,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lm": lm.op8_lm,
    "op9_pii": pii.op9_pii,
    "op10_mixing": mixing.op10_mixing,
    "op11_lexical": lexical.op11_lexical,
    "op12_simhash": simhash.op12_simhash,
    "op13_negatives": negatives.op13_negatives,
}
ORACLE: dict[str, str] = {"op1_suffix": suffix.OP1_SQL, "op4_top_k": topk.OP4_SQL, "op5_minhash": minhash.OP5_SQL, "op11_lexical": lexical.OP11_SQL,
                          "op13_negatives": negatives.OP13_SQL}
