"""Queries and SQL of this subpackage."""

from __future__ import annotations

from .bpe import op1_byte_bpe_prefix_dp
from .collocations import OP13_SQL, op13_collocations_rabin_karp
from .language_id import op8_language_bigru
from .mixing import op9_mixing_soft_membership
from .ngram_lm import op3_lm_elias_fano_trie
from .ordinal import op5_quality_ordinal
from .pii import op6_pii_feistel
from .product_quantisation import op4_embeddings_product_quantisation
from .secret_scan import OP11_SQL, op11_secrets_ownership
from .quality import op2_quality_suffix_array
from .simhash import op7_simhash_bk_tree
from .spelling import OP12_SQL, op12_spelling_trie_pairs
from .token_files import op10_token_files_mixing_coder


def queries() -> dict:
    return {
        "op1_byte_bpe_prefix_dp": op1_byte_bpe_prefix_dp,
        "op2_quality_suffix_array": op2_quality_suffix_array,
        "op3_lm_elias_fano_trie": op3_lm_elias_fano_trie,
        "op4_embeddings_product_quantisation": op4_embeddings_product_quantisation,
        "op5_quality_ordinal": op5_quality_ordinal,
        "op6_pii_feistel": op6_pii_feistel,
        "op7_simhash_bk_tree": op7_simhash_bk_tree,
        "op8_language_bigru": op8_language_bigru,
        "op9_mixing_soft_membership": op9_mixing_soft_membership,
        "op10_token_files_mixing_coder": op10_token_files_mixing_coder,
        "op11_secrets_ownership": op11_secrets_ownership,
        "op12_spelling_trie_pairs": op12_spelling_trie_pairs,
        "op13_collocations_rabin_karp": op13_collocations_rabin_karp,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_secrets_ownership": OP11_SQL, "op12_spelling_trie_pairs": OP12_SQL, "op13_collocations_rabin_karp": OP13_SQL}
