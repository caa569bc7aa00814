"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import ball_tree, bpe, chat, langid, lexical, minhash, packing, permutation_index, prefix_trie, quality_gam, secrets, sharding, suffix_dedup

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_permutation_index": permutation_index.op3_permutation_index,
    "op4_ball_tree": ball_tree.op4_ball_tree,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_minhash": minhash.op8_minhash,
    "op9_language_id": langid.op9_language_id,
    "op10_quality_gam": quality_gam.op10_quality_gam,
    "op11_chat_format": chat.op11_chat_format,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {"op4_ball_tree": ball_tree.OP4_SQL, "op5_secret_scan": secrets.OP5_SQL, "op6_suffix_dedup": suffix_dedup.OP6_SQL, "op8_minhash": minhash.OP8_SQL, "op11_chat_format": chat.OP11_SQL, "op12_lexical_search": lexical.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
