"""Registry of this subpackage: query name to function, and oracle SQL where SQL can express the query."""

from trajekt.llm import bpe, filters, jaccard, lines, mixing, packing, resampling, secrets, substrings, topk, toxicity, winnow, wordpiece

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_token_counts": wordpiece.op2_token_counts,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_document_fingerprints": winnow.op6_document_fingerprints,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_mixing": mixing.op10_mixing,
    "op11_bpe_round_trip": bpe.op11_bpe_round_trip,
    "op12_filter_audit": filters.op12_filter_audit,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLES = {"op1_ngram_jaccard_join": jaccard.OP1_SQL, "op3_line_dedup": lines.OP3_SQL, "op4_exact_top_k": topk.OP4_SQL, "op5_substring_dedup": substrings.OP5_SQL, "op10_mixing": mixing.OP10_SQL, "op12_filter_audit": filters.OP12_SQL}
