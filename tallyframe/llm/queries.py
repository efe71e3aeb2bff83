"""The queries of this package and their SQL twins."""

from __future__ import annotations

from tallyframe.llm.chosen_path import OP2_SQL, op2_ngram_join
from tallyframe.llm.language import op8_language_id
from tallyframe.llm.lines import OP6_SQL, op6_line_dedup
from tallyframe.llm.mixing import OP4_SQL, op4_mix_sources
from tallyframe.llm.packing import op7_pack_sequences
from tallyframe.llm.ranking import OP11_SQL, op11_ranked_search
from tallyframe.llm.resampling import op13_importance_resample
from tallyframe.llm.secrets import op9_secret_scan
from tallyframe.llm.suffixes import op5_suffix_dedup
from tallyframe.llm.urls import OP12_SQL, op12_url_filter
from tallyframe.llm.vectors import OP10_SQL, op10_vector_topk
from tallyframe.llm.warc import OP3_SQL, op3_warc
from tallyframe.llm.winnowing import op1_winnowing

QUERIES = {
    f.__name__: f
    for f in (
        op1_winnowing, op2_ngram_join, op3_warc, op4_mix_sources, op5_suffix_dedup, op6_line_dedup, op7_pack_sequences, op8_language_id, op9_secret_scan,
        op10_vector_topk, op11_ranked_search, op12_url_filter, op13_importance_resample,
    )
}
ORACLES = {
    "op2_ngram_join": OP2_SQL, "op3_warc": OP3_SQL, "op4_mix_sources": OP4_SQL, "op6_line_dedup": OP6_SQL, "op10_vector_topk": OP10_SQL,
    "op11_ranked_search": OP11_SQL, "op12_url_filter": OP12_SQL,
}
