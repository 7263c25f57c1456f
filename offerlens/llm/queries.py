"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import additive_ann, collocations, exact_dedup, kneser_ney, language, mixing, near_dedup, packing, pii, secret_scan, suffix_dedup, url_filter, vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        near_dedup.op1_near_dedup,
        mixing.op2_mixing,
        packing.op3_packing,
        suffix_dedup.op4_suffix_dedup,
        kneser_ney.op5_lm_scoring,
        pii.op6_pii,
        url_filter.op7_url_filter,
        additive_ann.op8_ann,
        language.op9_language_id,
        exact_dedup.op10_exact_dedup,
        secret_scan.op11_secret_scan,
        collocations.op12_collocations,
        vector_codes.op13_vector_codes,
    )
}
ORACLES = {"op2_mixing": mixing.OP2_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op12_collocations": collocations.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
