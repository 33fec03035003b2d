"""The queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, click_windows, heap_codes, host_rules, inner_product, ngram_join, packing, pii, rotated_codes, sharding, sql, toxicity, url_filter

QUERIES = {
    "op1_redirect_equivalence": url_filter.op1_redirect_equivalence,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_string_kernel_toxicity": toxicity.op3_string_kernel_toxicity,
    "op4_host_rules": host_rules.op4_host_rules,
    "op5_anisotropic_search": inner_product.op5_anisotropic_search,
    "op6_signature_tree_join": ngram_join.op6_signature_tree_join,
    "op7_permutation_sharding": sharding.op7_permutation_sharding,
    "op8_weak_supervision_pii": pii.op8_weak_supervision_pii,
    "op9_vector_packing": packing.op9_vector_packing,
    "op10_bpe_transducer": bpe.op10_bpe_transducer,
    "op11_click_windows": click_windows.op11_click_windows,
    "op12_rotated_codes": rotated_codes.op12_rotated_codes,
    "op13_heap_lloyd": heap_codes.op13_heap_lloyd,
}

ORACLES = {
    "op1_redirect_equivalence": sql.URL_RULES,
    "op2_chat_formatting": sql.CHAT,
    "op4_host_rules": sql.HOST_RULES,
    "op11_click_windows": sql.CLICK_WINDOWS,
    "op12_rotated_codes": sql.NEAR_VECTORS,
    "op13_heap_lloyd": sql.HEAP_LLOYD,
}
