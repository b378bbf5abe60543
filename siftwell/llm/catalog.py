"""The numbered operators as queries over the driver's tables, with SQL where it can express them."""

from siftwell.llm import align, bpe, decontaminate, huffman, lexical, line_dedup, preference, quality, similar, substrings, token_counts, toxicity, url_rules

QUERIES = {
    "op1_token_rollups": token_counts.op1_token_rollups,
    "op2_winnowing": decontaminate.op2_winnowing,
    "op3_recurrent_toxicity": toxicity.op3_recurrent_toxicity,
    "op4_weak_supervision": quality.op4_weak_supervision,
    "op5_huffman_ids": huffman.op5_huffman_ids,
    "op6_grouped_prefixes": similar.op6_grouped_prefixes,
    "op7_preference_pairs": preference.op7_preference_pairs,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_recompression": substrings.op9_recompression,
    "op10_url_rules": url_rules.op10_url_rules,
    "op11_line_runs": line_dedup.op11_line_runs,
    "op12_wavelet_search": lexical.op12_wavelet_search,
    "op13_align": align.op13_align,
}
ORACLE_SQL: dict[str, str] = {
    "op7_preference_pairs": preference.ORACLE_SQL,
    "op10_url_rules": url_rules.ORACLE_SQL,
    "op11_line_runs": line_dedup.ORACLE_SQL,
    "op12_wavelet_search": lexical.ORACLE_SQL,
}
