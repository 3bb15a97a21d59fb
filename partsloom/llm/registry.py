"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontaminate, impact_search, language_id, line_dedup, lm_scoring, mixing, release, sharding, simhash, spelling, substring_dedup, token_store, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_impact_search": impact_search.op5_impact_search,
    "op6_token_store": token_store.op6_token_store,
    "op7_language_id": language_id.op7_language_id,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_release": release.op11_release,
    "op12_warc": warc.op12_warc,
    "op13_spelling": spelling.op13_spelling,
}
SQL = {
    "op1_sharding": sharding.SQL,
    "op5_impact_search": impact_search.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_release": release.SQL,
    "op12_warc": warc.SQL,
    "op13_spelling": spelling.SQL,
}
