"""One registered query per operator of this subpackage, over its whole table."""

from __future__ import annotations

from tracefp.llm.bpe import op9_bpe
from tracefp.llm.contamination import op2_decontamination
from tracefp.llm.licenses import OP7_SQL, op7_license_scan
from tracefp.llm.lines import op3_line_dedup
from tracefp.llm.ngrams import OP4_SQL, op4_lm_scores
from tracefp.llm.prefix_trie import op13_conversation_trie
from tracefp.llm.rans import op5_token_files
from tracefp.llm.repair import op11_structure_repair
from tracefp.llm.secrets import op10_secret_scan
from tracefp.llm.simhash import op1_simhash
from tracefp.llm.toxicity import op8_toxicity
from tracefp.llm.transducer import op12_token_counts
from tracefp.llm.vectors import op6_embeddings

QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_decontamination, op3_line_dedup, op4_lm_scores, op5_token_files, op6_embeddings, op7_license_scan, op8_toxicity,
    op9_bpe, op10_secret_scan, op11_structure_repair, op12_token_counts, op13_conversation_trie)}
ORACLES = {"op4_lm_scores": OP4_SQL, "op7_license_scan": OP7_SQL}
