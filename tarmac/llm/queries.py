"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tarmac.llm.filter_audit import OP11_SQL, op11_filter_audit
from tarmac.llm.heap_lloyd import OP13_SQL, op13_heap_lloyd_codes
from tarmac.llm.jaccard import op8_pivot_jaccard_components
from tarmac.llm.ogg import op1_ogg_media
from tarmac.llm.packing import op7_differencing_packing
from tarmac.llm.quality import op6_site_shrunk_quality
from tarmac.llm.raking import op10_raked_mixture
from tarmac.llm.separators import op5_separator_scan
from tarmac.llm.sharding import op4_interleaved_shards
from tarmac.llm.simhash import op12_simhash_components
from tarmac.llm.token_rows import op3_best_fit_token_rows
from tarmac.llm.topk import OP9_SQL, op9_sorted_list_topk
from tarmac.llm.toxicity import op2_clause_grammar_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_ogg_media,
        op2_clause_grammar_toxicity,
        op3_best_fit_token_rows,
        op4_interleaved_shards,
        op5_separator_scan,
        op6_site_shrunk_quality,
        op7_differencing_packing,
        op8_pivot_jaccard_components,
        op9_sorted_list_topk,
        op10_raked_mixture,
        op11_filter_audit,
        op12_simhash_components,
        op13_heap_lloyd_codes,
    )
}
ORACLE_SQL: dict[str, str] = {"op9_sorted_list_topk": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_heap_lloyd_codes": OP13_SQL}
