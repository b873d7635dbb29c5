"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from coppice.llm.alignment import op12_token_alignment
from coppice.llm.centroids import clusters_sql, op11_lloyd_clusters
from coppice.llm.chat import op10_quotation_threads
from coppice.llm.decontaminate import op2_edit_decontamination
from coppice.llm.html import op7_template_text
from coppice.llm.langid import op6_kneser_ney_language
from coppice.llm.media import op8_progressive_jpeg
from coppice.llm.ngram_join import op1_set_relation_join
from coppice.llm.packing import op5_best_fit_packing
from coppice.llm.quality import op3_random_indexing_quality
from coppice.llm.sharding import op9_histogram_shards
from coppice.llm.token_counts import op4_trie_token_counts
from coppice.llm.tokenfiles import op13_seekable_token_files

QUERIES = {
    "op1_set_relation_join": op1_set_relation_join,
    "op2_edit_decontamination": op2_edit_decontamination,
    "op3_random_indexing_quality": op3_random_indexing_quality,
    "op4_trie_token_counts": op4_trie_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_kneser_ney_language": op6_kneser_ney_language,
    "op7_template_text": op7_template_text,
    "op8_progressive_jpeg": op8_progressive_jpeg,
    "op9_histogram_shards": op9_histogram_shards,
    "op10_quotation_threads": op10_quotation_threads,
    "op11_lloyd_clusters": op11_lloyd_clusters,
    "op12_token_alignment": op12_token_alignment,
    "op13_seekable_token_files": op13_seekable_token_files,
}

#: The others have none: each fits a model, runs a search to convergence or a codec.
ORACLES: dict[str, str] = {"op11_lloyd_clusters": clusters_sql()}
