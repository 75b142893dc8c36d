"""The registered queries of this subpackage and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from braidwell.llm.ann import OP5_SQL, op5_nearest_neighbours
from braidwell.llm.langid import op6_language_id
from braidwell.llm.lm import op8_lm_scoring
from braidwell.llm.mixing import op9_source_mixing
from braidwell.llm.packing import op2_best_fit_packing
from braidwell.llm.simhash import op1_simhash_near_dedup
from braidwell.llm.substring import op7_substring_dedup
from braidwell.llm.topk import OP3_SQL, op3_exact_topk
from braidwell.llm.urlfilter import op10_url_filter
from braidwell.llm.warc import op4_warc

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_topk": op3_exact_topk,
    "op4_warc": op4_warc,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_source_mixing": op9_source_mixing,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": OP3_SQL,
    "op4_warc": "SELECT page_id, url, html FROM pages",
    "op5_nearest_neighbours": OP5_SQL,
}
