"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from aerolith.llm.ann import op8_anisotropic_ann
from aerolith.llm.ball_tree import ORACLE_SQL as SEARCH_SQL
from aerolith.llm.ball_tree import op11_ball_tree_search
from aerolith.llm.bpe import op3_byte_bpe
from aerolith.llm.langid import op5_language_id
from aerolith.llm.licenses import op6_license_scan
from aerolith.llm.lm_score import op9_ctw_score
from aerolith.llm.media import op4_media_columns
from aerolith.llm.packing import op7_packing
from aerolith.llm.prefix_trie import ORACLE_SQL as TRIE_SQL
from aerolith.llm.prefix_trie import op12_prefix_trie
from aerolith.llm.sharding import ORACLE_SQL as SHARDS_SQL
from aerolith.llm.sharding import op13_sharding
from aerolith.llm.simhash import op10_simhash
from aerolith.llm.suffix_dedup import op1_suffix_dedup
from aerolith.llm.toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_byte_bpe, op4_media_columns, op5_language_id, op6_license_scan, op7_packing, op8_anisotropic_ann, op9_ctw_score, op10_simhash, op11_ball_tree_search, op12_prefix_trie, op13_sharding)}
ORACLE_SQL: dict[str, str] = {"op11_ball_tree_search": SEARCH_SQL, "op12_prefix_trie": TRIE_SQL, "op13_sharding": SHARDS_SQL}
