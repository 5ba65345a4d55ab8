"""The registered queries of this subpackage, and the SQL that gives the same rows where there is one."""

from talkloom.llm import attribution, chat, decontaminate, grammar, language, line_dedup, manifest, mixing, near_duplicates, negatives, neighbours, piecewise, toxicity

QUERIES = {
    "op1_language": language.op1_language,
    "op2_tokens": grammar.op2_tokens,
    "op3_chat": chat.op3_chat,
    "op4_token_counts": attribution.op4_token_counts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_near_duplicates": near_duplicates.op6_near_duplicates,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_fingerprints": piecewise.op12_fingerprints,
    "op13_manifest": manifest.op13_manifest,
}
ORACLES = {
    "op3_chat": chat.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_near_duplicates": near_duplicates.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
