"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op9_ann
from .embedding_dedup import OP2_SQL, op2_embedding_dedup
from .line_dedup import op1_line_dedup
from .mixing import op4_mixing
from .mtree import OP13_SQL, op13_mtree
from .packing import op10_packing
from .pii import op5_pii
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import op8_quality
from .simhash import op7_simhash
from .token_counts import op3_token_counts
from .tokenizer_alignment import op12_tokenizer_alignment
from .url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_ann": op9_ann,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_mtree": op13_mtree,
}
ORACLE_SQL = {"op2_embedding_dedup": OP2_SQL, "op6_url_filter": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op13_mtree": OP13_SQL}
