"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from fieldtally.llm.conversation_trie import OP11_SQL, op11_radix_trie
from fieldtally.llm.dartminhash import op2_dart_minhash
from fieldtally.llm.decontamination import op5_spaced_seeds
from fieldtally.llm.language import op6_kneser_ney
from fieldtally.llm.passages import op10_compact_windows
from fieldtally.llm.personal import op9_weak_supervision
from fieldtally.llm.quality import op1_mcd_outliers
from fieldtally.llm.segmentation import op3_gumbel_segmentations
from fieldtally.llm.sharding import op4_ring_shards
from fieldtally.llm.token_counts import op8_count_viterbi
from fieldtally.llm.token_files import op7_repair_tokens
from fieldtally.llm.toxicity import op13_naive_bayes_grams
from fieldtally.llm.vector_codes import OP12_SQL, op12_anchor_codes


def queries() -> dict:
    found = [
        op1_mcd_outliers,
        op2_dart_minhash,
        op3_gumbel_segmentations,
        op4_ring_shards,
        op5_spaced_seeds,
        op6_kneser_ney,
        op7_repair_tokens,
        op8_count_viterbi,
        op9_weak_supervision,
        op10_compact_windows,
        op11_radix_trie,
        op12_anchor_codes,
        op13_naive_bayes_grams,
    ]
    return {query.__name__: query for query in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op11_radix_trie": OP11_SQL, "op12_anchor_codes": OP12_SQL}
