"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, decontam, embed_dedup, html_extract, langid, lm, mixing, ngram_join, periodic, prefix_trie, sharding, tokenbin, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_language_id": langid.op5_language_id,
    "op6_embedding_near_dedup": embed_dedup.op6_embedding_near_dedup,
    "op7_token_files": tokenbin.op7_token_files,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
    "op10_pfair_mixing": mixing.op10_pfair_mixing,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_chat_formatting": chat.op13_chat_formatting,
}

ORACLE_SQL: dict[str, str] = {"op12_prefix_trie": prefix_trie.SQL, "op13_chat_formatting": chat.SQL}
