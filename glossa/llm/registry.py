"""Queries of the corpus operators, and their SQL where SQL can express them."""

from .bpe import op10_byte_bpe
from .collocations import OP11_SQL, op11_collocations
from .decontaminate import OP12_SQL, op12_wu_manber_decontamination
from .kdtree import op5_kd_tree_shards
from .mixing import OP1_SQL, op1_pfair_mixing
from .paragraphs import op9_paragraph_minhash
from .pii import op2_pii_surrogates
from .prefixtrie import OP13_SQL, op13_prefix_trie
from .quality import op8_quality_rules
from .simhash import op7_simhash_near_duplicates
from .suffixes import op6_sparse_suffix_array
from .vafile import OP3_SQL, op3_exact_top_k
from .warc import OP4_SQL, op4_warc_round_trip

QUERIES = {f.__name__: f for f in (op1_pfair_mixing, op2_pii_surrogates, op3_exact_top_k, op4_warc_round_trip, op5_kd_tree_shards, op6_sparse_suffix_array, op7_simhash_near_duplicates, op8_quality_rules, op9_paragraph_minhash, op10_byte_bpe, op11_collocations, op12_wu_manber_decontamination, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op1_pfair_mixing": OP1_SQL, "op3_exact_top_k": OP3_SQL, "op4_warc_round_trip": OP4_SQL, "op11_collocations": OP11_SQL, "op12_wu_manber_decontamination": OP12_SQL, "op13_prefix_trie": OP13_SQL}
