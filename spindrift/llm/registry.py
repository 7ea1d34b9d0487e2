"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from . import alignment, bpe, exact_dedup, html_text, lm, minhash, mixing, prefix_trie, quality, rp_forest, secrets, suffix_dedup, token_files

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_embedding_dedup": rp_forest.op2_embedding_dedup,
    "planted_vectors": rp_forest.planted_vectors,
    "op3_bpe": bpe.op3_bpe,
    "op4_near_dedup": minhash.op4_near_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_token_files": token_files.op6_token_files,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_html_text": html_text.op8_html_text,
    "op9_lm_score": lm.op9_lm_score,
    "op10_quality": quality.op10_quality,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_token_alignment": alignment.op13_token_alignment,
}

SQL = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op2_embedding_dedup": rp_forest.ORACLE_SQL,
    "planted_vectors": rp_forest.PLANTED_SQL,
    "op4_near_dedup": minhash.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_suffix_dedup": suffix_dedup.ORACLE_SQL,
}
