"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import chat, decontaminate, langid, licenses, lm, merkle, packing, quality, search, simhash, substring, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        licenses.op1_license_scans,
        langid.op2_language_id,
        packing.op3_best_fit_packing,
        simhash.op4_simhash_near_dedup,
        lm.op5_lm_scoring,
        decontaminate.op6_benchmark_decontamination,
        chat.op7_chat_formatting,
        substring.op8_substring_dedup,
        url_filter.op9_url_filters,
        quality.op10_quality_rules,
        warc.op11_warc,
        merkle.op12_merkle_manifest,
        search.op13_ranked_search,
    )
}
SQL = {"op6_benchmark_decontamination": decontaminate.SQL, "op7_chat_formatting": chat.SQL, "op9_url_filters": url_filter.SQL, "op11_warc": warc.SQL, "op12_merkle_manifest": merkle.SQL, "op13_ranked_search": search.SQL}
